"""Streams over many files, late rows and restarts equal the batch result."""

import os
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from gleaner.session import checkpoint_dir
from gleaner.streaming import jobs as R
from gleaner.streaming import outcomes
from gleaner.streaming.seen import SeenTable

SCHEMA = "key string, ts timestamp, seq long, state string"


def _write(spark, folder, name, rows):
    frame = spark.createDataFrame(rows, "key string, ts string, seq long, state string")
    frame.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(folder))


@pytest.fixture
def feed(spark, tmp_path):
    folder = tmp_path / "in"
    _write(spark, folder, "1", [("a", "2024-01-01 10:00", 1, "pending"), ("b", "2024-01-01 11:00", 2, "downloaded"), ("a", "2024-01-01 10:30", 3, "failed")])
    like = spark.read.parquet(str(folder))

    def stream():
        return R.read_stream(spark, str(folder), like, files=1)

    return folder, stream


def test_discovery_over_restarts(spark, tmp_path, feed):
    folder, stream = feed
    out, progress = str(tmp_path / "out"), str(tmp_path / "cp")
    R.start_discovery(stream(), out, progress, ["key"], ["seq"]).awaitTermination()
    _write(spark, folder, "2", [("b", "2024-03-01 10:00", 9, "x"), ("c", "2024-03-01 10:00", 10, "x"), ("c", "2024-03-01 11:00", 11, "x")])
    R.start_discovery(stream(), out, progress, ["key"], ["seq"]).awaitTermination()
    assert sorted((r["key"], r["seq"]) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 2), ("c", 10)]


def test_late_older_outcome_does_not_win(spark, tmp_path, feed):
    folder, stream = feed
    out, progress = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        R.start_changes(R.ledger_state(stream(), "key", "ts", "seq", ["state"]), out, progress).awaitTermination()

    run()
    _write(spark, folder, "2", [("b", "2023-12-31 10:00", 9, "failed"), ("a", "2024-01-02 10:00", 10, "downloaded")])
    run()
    assert {r["key"]: r["state"] for r in R.read_latest(spark, out, ["key"]).collect()} == {"a": "downloaded", "b": "downloaded"}


def test_metrics_drop_rows_beyond_the_watermark(spark, tmp_path, feed):
    folder, stream = feed
    out, progress = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        metrics = R.run_metrics(stream(), "ts", F.col("state") == "failed")
        R.start_changes(metrics, out, progress).awaitTermination()

    run()
    _write(spark, folder, "2", [("a", "2024-01-05 10:00", 9, "failed")])
    run()
    _write(spark, folder, "3", [("a", "2024-01-01 12:00", 10, "failed"), ("a", "2024-01-05 09:30", 11, "ok")])
    run()
    found = {str(r["start"])[:10]: (r["total"], r["failed"], r["success"]) for r in R.read_latest(spark, out, ["start"]).collect()}
    assert found == {"2024-01-01": (3, 1, 2), "2024-01-05": (2, 1, 1)}


def test_high_water_marks(spark, tmp_path, feed):
    folder, stream = feed
    out, progress = str(tmp_path / "out"), str(tmp_path / "cp")
    for rows in ([("a", "2024-01-05 10:00", 2, "x")], [("a", "2024-01-05 10:00", 30, "x"), ("z", "2024-01-05 10:00", 4, "x")]):
        _write(spark, folder, "n", rows)
        R.start_changes(R.high_water_marks(stream(), "key", "seq"), out, progress).awaitTermination()
    assert {r["key"]: r["high"] for r in R.read_latest(spark, out, ["key"]).collect()} == {"a": 30, "b": 2, "z": 4}


def test_repeated_batch_replaces_its_rows(spark, tmp_path, feed):
    _, stream = feed
    out = str(tmp_path / "out")
    for attempt in ("cp1", "cp2"):  # a lost progress folder runs batch 0 again
        R.start_changes(R.high_water_marks(stream(), "key", "seq"), out, str(tmp_path / attempt)).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_watermarked_discovery(spark, tmp_path, feed):
    _, stream = feed
    out = str(tmp_path / "out")
    R.start_changes(R.discover_stream(stream(), ["key"], "ts", "1 day"), out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["key"] for r in spark.read.parquet(out).collect()) == ["a", "b"]


@pytest.fixture
def one_partition(spark):
    """Fifty small batches need no more; the setting of the other tests comes back."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_batch_reads_only_the_buckets_it_may_hit(spark, tmp_path, monkeypatch, one_partition):
    table = SeenTable(spark, str(tmp_path / "seen"), ["key"], buckets=16, blocks=2)
    checkpoint_dir(spark)
    known, read, expected, found = table.known, [], set(), set()

    def noted(like, buckets, batch_id):
        frame = known(like, buckets, batch_id)
        files = {r[0] for r in frame.select(F.input_file_name()).distinct().collect()}
        read[-1] += sum(os.path.getsize(unquote(f.removeprefix("file://"))) for f in files)
        return frame

    monkeypatch.setattr(table, "known", noted)
    for n in range(50):
        keys = [f"k{n}-{i}" for i in range(12)] + ([f"k{n - 1}-3", None] if n else [None])
        rows = spark.createDataFrame([(k, n) for k in keys], "key string, batch int").coalesce(1)
        read.append(0)
        new = [(r.key, r.batch) for r in table.unseen(rows, n).collect()]
        found |= set(new)
        expected |= {(k, n) for k in keys if k not in {e[0] for e in expected}}
        table.add(spark.createDataFrame(new, "key string, batch int").coalesce(1), n)
    assert found == expected
    # two buckets of sixteen at most are read, but for keys that pass a filter by chance
    filters = sum(f.stat().st_size for f in (tmp_path / "seen" / "filters" / "slot=1").rglob("*.parquet"))
    everything = sum(f.stat().st_size for f in (tmp_path / "seen" / "keys").rglob("*.parquet"))
    assert 0 < max(read) < everything / 4 and filters < 16 * 2 * 4096
    assert sum(read[40:]) < 5 * sum(read[5:15])  # two buckets hold more keys by then, but no others are read


def test_batch_that_runs_again_does_not_see_itself(spark, tmp_path):
    checkpoint_dir(spark)
    table = SeenTable(spark, str(tmp_path / "seen"), ["key"], buckets=4)
    for n, keys in enumerate((["a", "b"], ["b", "c"], ["c", "d"], ["a", "e"])):
        rows = spark.createDataFrame([(k,) for k in keys], "key string")
        for _ in range(2):
            new = table.unseen(rows, n).checkpoint()
            assert sorted(r.key for r in new.collect()) == [["a", "b"], ["c"], ["d"], ["e"]][n]
            table.add(new, n)
    # without filters every bucket is read
    assert [r.key for r in table.unseen(spark.createDataFrame([("d",), ("x",)], "key string"), 9).collect()] == ["x"]


def _outcomes(spark, folder, out, progress):
    stream = R.read_stream(spark, str(folder), spark.read.parquet(str(folder)), files=1)
    state = outcomes.outcome_state(
        stream, "key", "ts", "seq", F.col("state"), F.col("state") == "downloaded", late="1 hour", keep="2 hours")
    query = outcomes.start_outcomes(state, out, progress)
    query.awaitTermination()
    rows = {r["key"]: r["status"] for r in outcomes.read_outcomes(spark, out, "key").collect()}
    kept = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
    return rows, kept


def test_finished_items_stay_finished_and_leave_the_state(spark, tmp_path, feed):
    folder, _ = feed
    out, progress = str(tmp_path / "out"), str(tmp_path / "cp")
    rows, _ = _outcomes(spark, folder, out, progress)
    assert rows == {"a": "failed", "b": "downloaded"}
    _write(spark, folder, "2", [("b", "2024-01-01 12:00", 9, "failed"), ("a", "2024-01-01 11:50", 10, "pending"), ("b", "2024-01-01 09:59", 11, "failed")])
    rows, _ = _outcomes(spark, folder, out, progress)  # restarts from the state that the first run left
    assert rows == {"a": "pending", "b": "downloaded"}
    for hour in range(10):  # the watermark moves on; each item finishes and expires
        _write(spark, folder, "x", [(f"n{hour}-{i}", f"2024-01-03 {hour + 10}:00", 100 + i, "downloaded") for i in range(20)])
    rows, kept = _outcomes(spark, folder, out, progress)
    assert len(rows) == 202 and rows["b"] == "downloaded"
    assert max(kept) <= 2 * 120 and kept[-1] < 200, kept  # rows of state and of timers, some hours' items at most
    _write(spark, folder, "y", [("b", "2024-01-03 19:30", 500, "failed")])  # its state is gone, the table still knows
    rows, _ = _outcomes(spark, folder, out, progress)
    assert rows["b"] == "downloaded" and rows["a"] == "pending"
