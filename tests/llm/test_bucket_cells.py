"""Buckets that need no search are left out before the shuffle, and buckets of the same members are searched once."""

from gleaner.llm import ngram_jaccard as nj

LABELS = "node long, component long"
FACTS = "kind byte, key long, a long, b long"


def test_a_bucket_of_two_is_a_pair_without_a_bucket(docs_of):
    words = [f"w{i}" for i in range(40)]
    text = " ".join(words)
    docs = docs_of([(1, text), (2, text + " x"), (3, "other words that nothing else has"), (4, None), (None, text)]).repartition(5)
    facts = [tuple(r) for r in nj._facts(docs, 4, 85, 100).collect()]
    assert not [f for f in facts if f[0] in (1, 3)]
    assert {f[1:] for f in facts if f[0] == 4} == {(None, 1, 2)}
    assert sorted(f[3] for f in facts if f[0] == 0 and f[3] is not None) == [1, 2, 3, 4]


def test_larger_buckets_keep_all_members(docs_of):
    words = [f"w{i}" for i in range(60)]
    docs = docs_of([(i, " ".join([*words, f"x{i}"])) for i in range(1, 7)])
    for parts in (1, 2, 6):
        facts = nj._facts(docs.repartition(parts), 4, 85, 100).where("kind in (1, 3)").collect()
        members = {}
        for f in facts:
            members.setdefault(f.key, set()).update({f.a, f.b} - {None})
        assert {1, 2, 3, 4, 5, 6} in members.values()
        found = nj.jaccard_components(docs.repartition(parts), 4, 85, 100).collect()
        assert {r.component_id for r in found} == {1}


def test_one_window_shuffles_the_signatures(docs_of, monkeypatch):
    plans = []
    monkeypatch.setattr(nj, "staged", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    nj._facts(docs_of([(1, "a b c d e")]), 4, 85, 100)
    assert plans[0].count("Exchange") == 1 and plans[0].count("Window [") == 1


def test_buckets_of_the_same_members_are_searched_once(spark):
    same = [(1, k, 1, d) for k in (10, 11, 12) for d in (2, 3)]
    facts = spark.createDataFrame([*same, (1, 13, 1, 2), (1, 13, 1, 4), (1, 14, 5, 6), (3, 15, None, 7), (3, 15, None, 8), (3, 15, None, 9)], FACTS)
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, 7), (8, 7), (9, 7)], LABELS)
    cells = nj._bucket_cells(facts, labels).collect()
    held = {}
    for c in cells:
        held.setdefault(c.key, set()).add((c.doc, c.outer))
    assert held == {10: {(1, False), (2, False), (3, False), (3, True)}, 13: {(1, False), (2, False), (4, False), (4, True)}}


def test_sets_of_no_other_documents_matter(spark, docs_of, monkeypatch):
    docs = docs_of([(i, f"a b c d {i}") for i in range(50)] + [(None, "x")])
    nodes = spark.createDataFrame([(7,), (9,)], "doc long")
    assert {7, 9} <= {r.doc for r in nj._sets_of(docs, nodes, 4).collect()} <= set(range(50))
    monkeypatch.setattr(nj, "_near_texts", lambda d, n: (d.selectExpr("doc_id doc", "text"), True))  # a full filter: the join drops the others
    assert {r.doc for r in nj._sets_of(docs, nodes, 4).collect()} == {7, 9}
