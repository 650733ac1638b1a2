"""Incremental jobs whose result equals the batch operators'.

State is kept by built-in aggregates in the state store. Every micro-batch writes its
changes to its own folder ``batch_id=n``, replaced as a whole if the batch runs again,
so a lost executor or a restart leaves each change in the table once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.streaming.seen import start_discovery  # noqa: F401 - a job like the others here


def read_stream(spark: SparkSession, folder: str, like: DataFrame, glob: str = "*.parquet", files: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream with the schema of ``like``."""
    return (
        spark.readStream.schema(like.schema).option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files).parquet(folder)
    )


def start_changes(
    stream: DataFrame, path: str, checkpoint: str, transform=None, available_now: bool = True, after=None
) -> StreamingQuery:
    """Write each micro-batch's changed rows to ``path``; ``transform(batch, batch_id)`` may shape them.

    ``after(batch, batch_id)`` runs when the batch's rows are written.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        shaped = transform(batch, batch_id) if transform else batch
        shaped.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if after:
            after(batch, batch_id)

    writer = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest change of each key."""
    changes = spark.read.parquet(path)
    rest = [c for c in changes.columns if c not in [*keys, "batch_id"]]
    newest = F.max_by(F.struct(*rest), "batch_id").alias("_row")
    return changes.groupBy(*keys).agg(newest).select(*keys, "_row.*")


# -- discovery --------------------------------------------------------------------------

def discover_stream(entries: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """First-seen entries while repeats come within ``delay``; state is bounded by the watermark."""
    timed = entries.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.dropDuplicatesWithinWatermark(keys)


# -- ledger state, metrics, marks -----------------------------------------------------------

def ledger_state(events: DataFrame, key: str, ts: str, tie: str, columns: list[str]) -> DataFrame:
    """Last state per item by event time: a late older outcome does not replace a newer one."""
    state = F.max_by(F.struct(ts, *columns), F.struct(ts, tie)).alias("_s")
    return events.groupBy(key).agg(state).select(key, "_s.*")


def run_metrics(events: DataFrame, ts: str, failed: Column, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Successes and failures per tumbling window; rows later than ``late`` drop."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width).alias("w")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(failed).alias("failed"),
        F.count_if(~failed).alias("success"),
    ).select(F.col("w.start").alias("start"), "total", "failed", "success")


def high_water_marks(chapters: DataFrame, parent: str, num: str) -> DataFrame:
    """Highest number per parent so far."""
    return chapters.groupBy(parent).agg(F.max(num).alias("high"))
