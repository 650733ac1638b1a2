"""Tables in buckets by key, changed bucket by bucket.

A change of some keys reads and writes the buckets that hold them; the files of all others stay as they
are. The new buckets are written aside first and then take the place of the old ones as whole folders
(dynamic partition overwrite), so a lost executor repeats its part and a failed job changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.joins import mark_moved, upsert_fill
from gleaner.operators.ledger import apply_outcomes
from gleaner.session import scratch_path


class KeyedTable:
    """A Parquet table at ``path`` in ``buckets`` folders by a hash of ``keys``, which are unique.

    A bucket is the least that a change rewrites: some hundred MB each are a good size. The number of buckets
    is part of the table. A null key lies in a bucket like others.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def create(self, rows: DataFrame) -> None:
        self._placed(rows).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(self.path)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; the folders of others are not opened."""
        rows = self.spark.read.parquet(self.path)
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket")

    def change(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the buckets of the changed keys by ``merge(their rows, changes)``; returns these buckets.

        ``merge`` may change and add rows of the changes' keys; it takes none away. The same change twice
        must give the same rows, as a run that was cut off may repeat it.
        """
        kinds = self.spark.read.parquet(self.path).schema
        typed = changes.withColumns({k: F.col(k).cast(kinds[k].dataType) for k in self.keys})  # equal keys hash alike
        touched = sorted(r.bucket for r in self._placed(typed).select("bucket").distinct().collect())  # a number per bucket
        if not touched:
            return touched
        aside = scratch_path(self.spark, "changed-buckets")
        self._placed(merge(self.read(touched), typed)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(aside)
        self.spark.read.parquet(aside).hint("rebalance", "bucket").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return touched

    def upsert(self, incoming: DataFrame, columns: list[str], order: str | None = None) -> list[int]:
        """``upsert_fill`` of the incoming rows."""
        return self.change(incoming, lambda old, new: upsert_fill(old, new, self.keys, columns, order))

    def mark_moved(self, moved: DataFrame, moved_at: Column) -> list[int]:
        return self.change(moved, lambda old, new: mark_moved(old, new, self.keys, moved_at))

    def apply_outcomes(self, outcomes: DataFrame, run_ts: Column) -> list[int]:
        return self.change(outcomes, lambda old, new: apply_outcomes(old, new, self.keys, run_ts))
