"""One law at every size: the period where it is asked for, as in ``OP3_SQL``, else the tree."""

from pyspark.sql import functions as F
from test_mixing import brute

from gleaner.llm.mixing import BLOCK_ROWS, PERIOD, mix, op3_mixing, source_parts


def table(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, n long")
    return rows.select("source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).select(
        F.xxhash64("source", "i").alias("doc_id"), "source")


def test_query_keeps_its_period_on_long_runs(spark, tmp_path):
    sizes = {"hot": 70_000, "mid": 9_000, "low": 700}
    table(spark, sizes).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    parts = {r.source: r.parts for r in source_parts(docs, None, 0.5, PERIOD).collect()}
    want = brute(parts, {s: -(-n // BLOCK_ROWS) for s, n in sizes.items()}, PERIOD)
    got = op3_mixing(spark, str(tmp_path)).select("source", "block", "slot").distinct().collect()
    assert {(r.source, r.block): r.slot for r in got} == {(s, b): slot for s, slots in want.items() for b, slot in enumerate(slots)}


def test_blocks_keep_their_slots_when_the_table_grows(spark):
    targets = {"a": 5, "b": 2.5, "c": 1.1}
    slots = [{(r.source, r.block): r.slot for r in mix(table(spark, {s: n for s in targets}), targets, block_rows=1).collect()}
             for n in (40, 6_000)]
    assert slots[0].items() <= slots[1].items()
