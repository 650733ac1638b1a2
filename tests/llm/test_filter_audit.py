"""Filter audit: every count of every order against brute force; repeated ids, nulls, empty tables."""

import re
from itertools import permutations

from pyspark.sql import functions as F

from gleaner.llm.filter_audit import audit, failing_ids, op11_filter_audit

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def slow_audit(docs, fails, good, toxic, names):
    """docs: (doc_id, part) rows; fails: doc_id to the set of failed filters."""
    out = {}
    for part in {p for _, p in docs}:
        ids = [d for d, p in docs if p == part]
        total = dict.fromkeys(names, 0)
        for order in permutations(names):
            left = ids
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in fails.get(d, "")]
                left = [d for d in left if f not in fails.get(d, "")]
                total[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in fails.get(d, "") for d in ids) - len(gone),
                    sum(set(fails.get(d, "")) == {f} for d in ids), sum(d in good for d in gone), sum(d in toxic for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def found(frame):
    return {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in frame.collect()}


def test_documents_equal_brute_force(spark, sf_dir):
    docs, fails, first = spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), {}, {}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    for d in sorted(docs, key=lambda d: d.doc_id):
        text = d.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails[d.doc_id] = {name for name, bad in {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": re.search(r"[#$%&*|]", text),
            "E": text in first}.items() if bad}
        first.setdefault(text, d.doc_id)
    want = slow_audit([(d.doc_id, d.lang or "") for d in docs], fails, {x.doc_id for x in labels if x.quality == 1},
                      {x.doc_id for x in labels if x.toxic == 1}, "ABCDE")
    got = found(op11_filter_audit(spark, sf_dir))
    assert got == want and len(got) == 600 * len({d.lang or "" for d in docs})


def test_nulls_repeats_and_unused_filters(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "x"), (2, "x"), (None, "x"), (None, None), (3, None), (4, "")], "doc_id long, lang string")
    docs = docs.withColumn("class", F.lit(1)).withColumn("part", F.lit("own")).withColumn("_failing", F.lit(2))
    labels = spark.createDataFrame([(2, 1, None), (2, 0, 1), (None, 1, 1), (3, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    ids = {"P": [2, None], "Q": [2, 3, 77], "R": []}
    failing = {n: spark.createDataFrame([(i,) for i in v], "doc_id long") for n, v in ids.items()}
    fails = {d: {n for n, v in ids.items() if d in v} for d in (1, 2, 3, 4, None)}
    rows = [(1, "x"), (2, "x"), (2, "x"), (None, "x"), (None, ""), (3, ""), (4, "")]
    assert found(audit(docs, labels, failing)) == slow_audit(rows, fails, {2}, {2}, "PQR")
    assert audit(docs.where("doc_id > 9"), labels, failing).count() == 0
    assert found(audit(docs, labels.where("quality = 7"), failing)) == slow_audit(rows, fails, set(), set(), "PQR")


def test_failing_ids(docs_of):
    long = " ".join(f"w{i}" for i in range(200))
    docs = docs_of([(1, None), (2, ""), (3, long), (4, long), (4, "short"), (None, long), (5, "A" + long), (6, "a " * 300), (7, "a|" + long),
                    (8, "AAAA " + long), (9, long + " x" * 100_000), (3, long)])
    got = {n: {r.doc_id for r in df.collect()} for n, df in failing_ids(docs).items()}
    assert got == {"A": {1, 2, 4}, "B": {6, 9}, "C": set(), "D": {7}, "E": {2, 4}}
    assert failing_ids(docs_of([(1, "ABCD " * 300)]))["C"].count() == 1
    none = failing_ids(docs.where("doc_id < 0"))
    assert all(df.count() == 0 for df in none.values())
