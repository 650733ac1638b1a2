"""The filter before the join of texts drops most other documents where they lie, and none that is asked for."""

import pytest
from pyspark.sql import functions as F

from gleaner.llm import ngram_jaccard


def shuffled_rows(frame):
    """Rows that pass the filter, before the join with the nodes."""
    passed = []
    join = type(frame).join

    def seen(self, other, on=None, how=None):
        if on == "doc":
            passed.append(self.count())
        return join(self, other, on, how)

    return passed, seen


@pytest.mark.parametrize("blocks", [1, 8192])
def test_few_other_texts_reach_the_join(spark, monkeypatch, blocks):
    docs = spark.range(-5000, 15000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(None, "x"), (7, "again"), (14, None)], "doc_id long, text string"))
    nodes = spark.range(-700, 3500, 7).select(F.col("id").alias("doc"))
    monkeypatch.setattr(ngram_jaccard, "MOST_BLOCKS", blocks)
    passed, seen = shuffled_rows(docs)
    with monkeypatch.context() as m:
        m.setattr(type(docs), "join", seen)
        found = ngram_jaccard._texts_of(docs, nodes)
        rows = sorted((r.doc, r.text) for r in found.where("text is not null").collect())
    assert rows == sorted([(i, f"t{i}") for i in range(-700, 3500, 7)] + [(7, "again")])
    assert found.where("text is null").count() == 1 and passed[0] < 600 + 2 + 2500


def test_no_nodes(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert ngram_jaccard._texts_of(docs, spark.createDataFrame([], "doc long")).count() == 0


def test_the_filter_comes_before_the_shuffle(spark):
    docs, nodes = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), spark.range(50).select(F.col("id").alias("doc"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = ngram_jaccard._texts_of(docs, nodes)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert 0 < plan.index("SortMergeJoin") < plan.index("Exchange hashpartitioning(doc") < plan.index("BroadcastHashJoin")
