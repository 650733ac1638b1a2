"""First-seen entries of a stream, checked against a bucketed table of known keys.

Known keys lie in ``buckets`` by a hash of the key. Each bucket has a Bloom filter, kept as ``blocks`` bitmaps of
Spark's fixed size: a key sets ``PROBES`` bits of one block. A batch reads the filters, whose size never grows, and
then only the buckets in which one of its keys may lie; keys that no filter holds are new without a look at the
table. A fuller filter lets more keys through to the table, so it costs reads and never a row.

Everything a batch writes replaces what an earlier attempt of the same batch wrote, and a batch reads only
what earlier batches wrote; the filters alternate between two folders for that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.sequences import dedup_first
from gleaner.session import checkpoint_dir

PROBES = 4
#: Bits of one of Spark's bitmaps.
BLOCK_BITS = 32_768


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_of_{k}"]) for k in keys])


class SeenTable:
    """Known keys below ``path``, which holds ``keys/batch_id=n/bucket=b`` and ``filters/slot=n mod 2/upto=n``.

    ``buckets * blocks`` bitmaps of 4 KB are read per batch. With 3,000 keys a bitmap one key in a hundred
    passes its filter by chance; a bucket should hold some hundred MB at most.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64, blocks: int = 16):
        self.spark, self.path, self.keys, self.buckets, self.blocks = spark, path, keys, buckets, blocks

    def placed(self, rows: DataFrame) -> DataFrame:
        """The different keys of rows with ``bucket``, ``block`` and the bits ``probes`` of the block."""
        value = F.xxhash64(*self.keys)
        probes = F.array(*[F.pmod(F.xxhash64(F.lit(i), *self.keys), F.lit(BLOCK_BITS)) for i in range(PROBES)])
        return rows.select(*self.keys).distinct().withColumns({
            "bucket": F.pmod(value, F.lit(self.buckets)).cast("int"),
            "block": F.pmod(F.shiftright(value, 32), F.lit(self.blocks)).cast("int"), "probes": probes})

    def filters_before(self, batch_id: int) -> DataFrame | None:
        """(bucket, block, bits) as the batch before left them; None if there are none, so that all buckets are read."""
        path = f"{self.path}/filters/slot={(batch_id - 1) % 2}/upto={batch_id - 1}"
        try:
            return self.spark.read.schema("bucket int, block int, bits binary").parquet(path)
        except AnalysisException:
            return None

    def possible(self, wanted: DataFrame, batch_id: int) -> DataFrame:
        """Those of the placed keys that an earlier batch may have brought."""
        filters = self.filters_before(batch_id)
        if filters is None:
            return wanted
        met = F.expr("forall(probes, p -> shiftright(int(conv(hex(substring(bits, int(p div 8) + 1, 1)), 16, 10)), int(p % 8)) & 1 = 1)")
        return wanted.join(filters, ["bucket", "block"]).where(met)

    def known(self, like: DataFrame, buckets: list[int], batch_id: int) -> DataFrame:
        """Keys of earlier batches in some buckets; other buckets are not read."""
        columns = ", ".join(f"`{k}` {like.schema[k].dataType.simpleString()}" for k in self.keys)
        keys = self.spark.read.schema(f"{columns}, batch_id bigint, bucket int").parquet(f"{self.path}/keys")
        return keys.where(F.col("bucket").isin(buckets) & (F.col("batch_id") < batch_id)).select(*self.keys)

    def unseen(self, first: DataFrame, batch_id: int) -> DataFrame:
        """Rows (one per key) whose key no earlier batch brought."""
        if batch_id == 0:
            return first
        asked = self.possible(self.placed(first), batch_id).select(*self.keys, "bucket").checkpoint()
        buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]  # a number per bucket at most
        if not buckets:
            return first
        old = self.known(asked, buckets, batch_id).withColumnsRenamed({k: f"_of_{k}" for k in self.keys})
        seen = asked.join(old, _same(asked, old, self.keys), "left_semi").withColumnsRenamed({k: f"_of_{k}" for k in self.keys})
        return first.join(seen, _same(first, seen, self.keys), "left_anti")

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Keep the keys of a batch's new rows and bring the filters up to it."""
        placed = self.placed(rows).checkpoint()
        placed.select(*self.keys, "bucket").hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.path}/keys/batch_id={batch_id}")
        bits = placed.select("bucket", "block", F.explode("probes").alias("bit")).groupBy("bucket", "block").agg(
            F.bitmap_construct_agg("bit").alias("bits"))
        before = self.filters_before(batch_id)
        if before is not None:
            bits = before.unionByName(bits).groupBy("bucket", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
        if batch_id == 0 or before is not None:
            bits.withColumn("upto", F.lit(batch_id)).coalesce(1).write.mode("overwrite").partitionBy("upto").parquet(
                f"{self.path}/filters/slot={batch_id % 2}")


def start_discovery(
    entries: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], buckets: int = 64, blocks: int = 16
) -> StreamingQuery:
    """First-seen entries however late a repeat comes: ``path/batch_id=n`` gets what batch n brought first.

    The known keys lie beside them, in ``path-seen``; see ``SeenTable`` for their size. A null is a key like
    others. Of equal keys in one batch the first by ``order`` counts.
    """
    from gleaner.streaming.jobs import start_changes

    spark = entries.sparkSession
    checkpoint_dir(spark)

    def fresh(batch: DataFrame, batch_id: int) -> DataFrame:
        return SeenTable(batch.sparkSession, f"{path}-seen", keys, buckets, blocks).unseen(
            dedup_first(batch, keys, order).checkpoint(), batch_id)

    def keep(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        written = session.read.schema(batch.schema).parquet(f"{path}/batch_id={batch_id}")
        SeenTable(session, f"{path}-seen", keys, buckets, blocks).add(written, batch_id)

    return start_changes(entries, path, checkpoint, fresh, after=keep)
