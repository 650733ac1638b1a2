"""Ledger state of a stream of outcomes, one state variable per item.

A finished item stays finished: outcomes are ranked by (finished, event time, tie), so that a late failure never
replaces a success. A timer drops a finished item's state once the watermark is ``keep`` behind its outcome, so the
state holds open items and recently finished ones only. The rank goes into the table of changes, where it also
decides between rows that were written before and after the state was dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gleaner.streaming.jobs import start_changes

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RANK = ["finished", "at", "tie"]


class LastOutcome(StatefulProcessor):
    """The highest outcome of each item; finished items expire ``keep_ms`` after their outcome."""

    def __init__(self, key: str, keep_ms: int):
        self.key, self.keep_ms = key, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "finished boolean, at timestamp, tie long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.best.get() if self.best.exists() else None
        best = old
        for frame in rows:
            for row in frame[[*RANK, "status"]].itertuples(index=False, name=None):
                if best is None or row[:3] > tuple(best[:3]):
                    best = row
        if best is old:
            return
        finished, at, tie, status = best
        self.best.update((bool(finished), pd.Timestamp(at).to_pydatetime(), int(tie), status))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if finished:
            due = int(pd.Timestamp(at).timestamp() * 1000) + self.keep_ms
            self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({self.key: [key[0]], "finished": [bool(finished)], "at": [pd.Timestamp(at)], "tie": [int(tie)], "status": [status]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.best.clear()
        return iter(())

    def close(self) -> None:
        pass


def _highest_of_batch(key: str):
    """Each Arrow batch's highest row per item, so that a hot item's rows meet its state as few ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas().sort_values(RANK, kind="stable").drop_duplicates(key, keep="last")
            yield pa.RecordBatch.from_pandas(frame, schema=batch.schema, preserve_index=False)

    return run


def outcome_state(events: DataFrame, key: str, ts: str, tie: str, status: Column, finished: Column, late: str, keep: str) -> DataFrame:
    """Changes ``(key, finished, at, tie, status)`` of each item's state.

    ``events`` is a stream; ``late`` bounds how late a row may come, ``keep`` how long a finished item is
    remembered. Rows without key, time or tie are no outcomes; a null status is one.
    """
    spark = events.sparkSession
    keep_ms = int(spark.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {keep})").first()[0])
    rows = events.select(
        F.col(key), F.coalesce(finished, F.lit(False)).alias("finished"), F.col(ts).cast("timestamp").alias("at"),
        F.col(tie).cast("long").alias("tie"), status.alias("status")).where(f"`{key}` is not null and at is not null and tie is not null")
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, finished boolean, at timestamp, tie long, status string"
    reduced = rows.mapInArrow(_highest_of_batch(key), schema).withWatermark("at", late)
    return reduced.groupBy(key).transformWithStateInPandas(
        LastOutcome(key, keep_ms), outputStructType=schema, outputMode="Update", timeMode="EventTime")


def start_outcomes(state: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the changes of ``outcome_state`` to ``path``, with the state in RocksDB, as its timers ask for."""
    conf = state.sparkSession.conf
    name = "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, PROVIDER)  # a started query keeps the settings that it started with
    try:
        return start_changes(state, path, checkpoint)
    finally:
        conf.set(name, before)


def read_outcomes(spark: SparkSession, path: str, key: str) -> DataFrame:
    """``(key, at, status)``: the highest change of each item."""
    best = F.max_by(F.struct("at", "status"), F.struct(*RANK)).alias("_row")
    return spark.read.parquet(path).groupBy(key).agg(best).select(key, "_row.*")
