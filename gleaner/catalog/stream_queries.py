"""Streaming jobs over the given tables, each run to the end of its input."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.catalog.inputs import table
from gleaner.catalog.registry import query
from gleaner.session import scratch_path
from gleaner.streaming import jobs as R
from gleaner.streaming import outcomes


def _stream(spark, d, name):
    """A given table as a stream, be it one file or a folder of files; the braces make a pattern of its path, which both match."""
    return R.read_stream(spark, f"{d}/{{{name}.parquet}}", table(spark, d, name), glob="*")


def _run(start, spark, name):
    path = scratch_path(spark, name)
    start(path, scratch_path(spark, f"{name}-progress")).awaitTermination()
    return path


@query("r01_discover_stream", "SELECT user_id, count(*) > 0 AS seen FROM events GROUP BY user_id")
def r01(spark, d):
    entries = R.discover_stream(_stream(spark, d, "events").select("user_id", "ts"), ["user_id"], "ts", "60 days")
    path = _run(lambda p, c: R.start_changes(entries, p, c), spark, "discovered")
    return spark.read.parquet(path).select("user_id", F.lit(True).alias("seen"))


@query("r01_discover_ledger", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def r01_ledger(spark, d):
    entries = _stream(spark, d, "events").select("user_id", "event_id")
    path = _run(lambda p, c: R.start_discovery(entries, p, c, ["user_id"], ["event_id"]), spark, "first-seen")
    return spark.read.parquet(path).drop("batch_id")


@query("r02_ledger_stream", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS at FROM events GROUP BY user_id")
def r02(spark, d):
    state = R.ledger_state(_stream(spark, d, "events"), "user_id", "ts", "event_id", ["event_type"])
    path = _run(lambda p, c: R.start_changes(state, p, c), spark, "ledger-state")
    return R.read_latest(spark, path, ["user_id"]).select(
        "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("r02_ledger_outcomes", """SELECT user_id, arg_max(event_type, (event_type = 'purchase', ts, event_id)) AS event_type,
 strftime(arg_max(ts, (event_type = 'purchase', ts, event_id)), '%Y-%m-%d %H:%M:%S') AS at FROM events GROUP BY user_id""")
def r02_outcomes(spark, d):
    """A purchase finishes a user; whatever comes later leaves them finished."""
    kind = F.col("event_type")
    state = outcomes.outcome_state(
        _stream(spark, d, "events"), "user_id", "ts", "event_id", kind, kind == "purchase", late="1 day", keep="7 days")
    path = _run(lambda p, c: outcomes.start_outcomes(state, p, c), spark, "outcomes")
    return outcomes.read_outcomes(spark, path, "user_id").select(
        "user_id", F.col("status").alias("event_type"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("r03_run_metrics_stream", """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type <> 'error') AS success FROM events GROUP BY 1""")
def r03(spark, d):
    metrics = R.run_metrics(_stream(spark, d, "events"), "ts", F.col("event_type") == "error")
    path = _run(lambda p, c: R.start_changes(metrics, p, c), spark, "metrics")
    return R.read_latest(spark, path, ["start"]).select(
        F.date_format("start", "yyyy-MM-dd").alias("day"), "total", "failed", "success")


@query("r04_new_chapter_stream", "SELECT conv_id, max(turn) + 1 AS high FROM conversations GROUP BY conv_id")
def r04(spark, d):
    chapters = _stream(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("num"))
    path = _run(lambda p, c: R.start_changes(R.high_water_marks(chapters, "conv_id", "num"), p, c), spark, "marks")
    return R.read_latest(spark, path, ["conv_id"])
