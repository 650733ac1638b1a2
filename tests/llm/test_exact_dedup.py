"""Exact dedup: collisions, ties, repeats, nulls."""

import hashlib

from pyspark.sql import functions as F

from gleaner.llm.exact_dedup import drop_exact_copies, exact_groups, op2_exact_dedup


def test_all_documents_equal_brute_force(spark, sf_dir):
    texts, got = {}, op2_exact_dedup(spark, sf_dir).collect()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        texts.setdefault(r.text or "", []).append(r.doc_id)
    want = {(d, max(ids), len(ids), d == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in texts.items() for d in ids}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_collisions_of_a_weak_hash_are_told_apart_by_bytes(docs_of, by_id):
    docs = docs_of([(i, f"text {i % 7}") for i in range(40)])
    weak = exact_groups(docs, "largest", lambda t: F.substring(F.md5(t), 1, 1).cast("binary"))
    strong = exact_groups(docs, "largest")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert by_id(weak.select(columns)) == by_id(strong.select(columns))
    assert all(r["group_size"] in (5, 6) for r in by_id(weak).values())


def test_edge_cases(docs_of, by_id):
    docs = docs_of([(1, None), (2, ""), (3, "a"), (3, "a"), (4, "a"), (None, "a"), (5, "a "), (6, "x" * 200_000)])
    found = by_id(exact_groups(docs))
    assert (found[1]["keep_id"], found[2]["keep_id"], found[2]["kept"]) == (1, 1, False)
    assert (found[3]["copies"], found[3]["kept"], found[3]["group_size"]) == (2, True, 4)
    assert found[None]["keep_id"] == 3 and not found[None]["kept"]
    assert found[5]["group_size"] == found[6]["group_size"] == 1
    clashing = ["kept", "content_hash", "_id", "_hash", "_others", "copies", "sha"]
    kept = drop_exact_copies(docs.withColumns({c: F.lit(f"own {c}") for c in clashing}))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6]
    assert kept.columns == [*docs.columns, *clashing] and all(r[c] == f"own {c}" for r in kept.collect() for c in clashing)


def test_empty_table(docs_of):
    none = docs_of([(1, "a")]).where("doc_id < 0")
    assert exact_groups(none).count() == 0 and drop_exact_copies(none).count() == 0
