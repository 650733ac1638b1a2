"""Ledger joins, state changes and whole runs on small inputs."""

import math
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import aggregates as A
from gleaner.operators import joins as J
from gleaner.operators import ledger as L
from gleaner.operators import selection as S
from gleaner.plans import blogs, bookmarks, novels
from gleaner.sources.keyed import KeyedTable


def test_discover_new_is_unique_and_unknown(spark):
    entries = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), ("c", 4)], "slug string, ord long")
    ledger = spark.createDataFrame([("b",)], "slug string")
    found = [tuple(r) for r in J.discover_new(entries, ledger, ["slug"], ["ord"]).orderBy("slug").collect()]
    assert found == [("a", 1, "pending"), ("c", 4, "pending")]


def test_upsert_fill_keeps_old_values(spark):
    base = spark.createDataFrame([(1, "old", 5), (2, "two", None)], "id long, title string, n long")
    new = spark.createDataFrame(
        [(1, None, 7, 1), (3, "a", None, 1), (3, None, 9, 2), (3, "b", None, 3)], "id long, title string, n long, o long")
    found = {r["id"]: (r["title"], r["n"]) for r in J.upsert_fill(base, new, ["id"], ["title", "n"], order="o").collect()}
    assert found == {1: ("old", 7), 2: ("two", None), 3: ("b", 9)}


def test_join_per_parent_spreads_a_hot_parent(spark):
    children = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("p"), F.col("id").alias("c"))
    parents = spark.range(0, 3000, 2).select(F.col("id").alias("p"), (F.col("id") * 2).alias("v"))
    joined = J.join_per_parent(children, parents, ["p"], ["c"])
    assert joined.count() == 3000
    assert joined.filter("p = 0 and v = 0").count() == 1000
    assert joined.filter("p % 2 = 1 and v is not null").count() == 0


@pytest.mark.parametrize("rows", [3_000, 60_000])
def test_hot_parent_reaches_all_tasks_at_any_size(spark, rows):
    settings = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        children = spark.range(rows).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("int").alias("p"), F.col("id").alias("c"))
        parents = spark.range(rows).select(F.col("id").alias("p"), (F.col("id") * 2).alias("v"))  # a long here, an int there
        assert [s for _, s in J.heavy_hitters(children, ["p"])] == [math.ceil(32 * math.ceil(rows / 3) * 32 / rows)]
        joined = J.join_per_parent(children, parents, ["p"], ["c"])
        held = joined.groupBy(F.spark_partition_id().alias("t")).agg(F.count_if(F.col("p") == 0).alias("hot"), F.count("*").alias("n")).collect()
        assert joined.where("v = 2 * p").count() == rows
        assert sum(r.hot > 0 for r in held) == 32 and max(r.n for r in held) <= 2 * rows / 32
        cold = J.join_per_parent(children.where("c % 3 <> 0"), parents, ["p"])
        assert "_slot" not in cold._jdf.queryExecution().optimizedPlan().toString()
        assert J.join_per_parent(children, parents.where("p <> 0"), ["p"], ["c"], "left_anti").count() == math.ceil(rows / 3)
        assert J.join_per_parent(children.where("c < 0"), parents, ["p"]).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_null_keys_of_children_spread_and_match_nothing(spark):
    children = spark.createDataFrame([(None, i) for i in range(50)] + [(1, 60)], "p long, c long")
    parents = spark.createDataFrame([(None, "n"), (1, "one")], "p long, v string")
    found = {r.c: r.v for r in J.join_per_parent(children, parents, ["p"]).collect()}
    assert found == {**dict.fromkeys(range(50)), 60: "one"}


def test_later_sources_see_misses_only(spark):
    items = spark.range(40).withColumnRenamed("id", "k")
    asked = []

    def source(keep, name, repeat=1):
        def read(rows):
            asked.append(sorted(r.k for r in rows.collect()))
            content = F.when(keep, F.concat(F.lit(name), F.col("k")))
            return reduce(DataFrame.unionByName, [rows.select("k", content.alias("content"))] * repeat)
        return read

    found = J.first_success(items, "k", source(F.col("k") < 10, "a"), source(F.col("k") % 2 == 0, "b", repeat=2), source(F.col("k") == 11, "c"))
    rows = {r.k: (r.content, r.origin) for r in found.collect()}
    assert asked == [list(range(40)), list(range(10, 40)), list(range(11, 40, 2))]
    assert found.count() == 40 and rows[4] == ("a4", 0) and rows[12] == ("b12", 1) and rows[11] == ("c11", 2) and rows[13] == (None, None)


def test_mark_moved_keeps_other_times(spark):
    ledger = spark.createDataFrame(
        [("s", "a", False, None), ("s", "b", True, "2020-01-01"), ("t", "a", False, None)],
        "site string, slug string, in_obsidian boolean, moved_at string").withColumn("moved_at", F.col("moved_at").cast("timestamp"))
    moved = spark.createDataFrame([("s", "a"), ("s", "a")], "site string, slug string")
    done = J.mark_moved(ledger, moved, ["site", "slug"], F.lit("2024-05-06").cast("timestamp"))
    found = {(r["site"], r["slug"]): (r["in_obsidian"], str(r["moved_at"])[:10]) for r in done.collect()}
    assert found == {("s", "a"): (True, "2024-05-06"), ("s", "b"): (True, "2020-01-01"), ("t", "a"): (False, "None")}


def test_routing_can_be_switched_off(spark):
    marks = spark.createDataFrame([(1, "https://medium.com/@u/p-1", "t")], "raindrop_id long, url string, title string")
    other = spark.createDataFrame([], "slug string")
    kept, routed = J.route_items(marks, other, route=False)
    assert [r["status"] for r in kept.collect()] == ["pending"] and routed.count() == 0


def test_status_counts_add_up(spark):
    rows = [("a", "pending"), ("a", "failed"), ("b", "downloaded"), ("b", "downloaded"), ("b", "skipped_medium")]
    counts = {(r["source"], r["status"]): r["count"] for r in A.status_counts(
        spark.createDataFrame(rows, "source string, status string"), ["source"]).collect()}
    assert counts[("*", "total")] == 5 and counts[("b", "total")] == 3
    assert sum(n for (s, k), n in counts.items() if s != "*" and k != "total") == 5


def test_select_items_treats_empty_as_no_filter(spark):
    ledger = spark.createDataFrame([(2, "x", "s"), (1, "y", "t")], "id long, status string, source string")
    assert [r["id"] for r in S.select_items(ledger, status="", source=None, limit=0).collect()] == [1, 2]
    assert S.get_item(ledger.withColumn("name", F.lit("n"))).count() == 0


def test_apply_outcomes(spark):
    ledger = spark.createDataFrame([("a", "pending", "A"), ("b", "pending", "B"), ("c", "downloaded", "C")], "slug string, status string, title string")
    error = "error struct<reason:string,detail:string,html:string>"
    outcomes = spark.createDataFrame(
        [("a", None, "x", 1, 2, "p", None), ("b", "new", None, None, None, None, ("timeout", "d", ""))],
        f"slug string, title string, author string, word_count long, char_count long, file_path string, {error}")
    rows = {r["slug"]: r for r in L.apply_outcomes(ledger, outcomes, ["slug"], F.lit("2024-05-06").cast("timestamp")).collect()}
    assert (rows["a"]["status"], rows["a"]["title"], rows["a"]["file_path"]) == ("downloaded", "A", "p")
    assert (rows["b"]["status"], rows["b"]["title"], rows["b"]["error_reason"], rows["b"]["downloaded_at"]) == ("failed", "B", "timeout", None)
    assert (rows["c"]["status"], rows["c"]["downloaded_at"]) == ("downloaded", None)


def test_rebuilt_navigation_is_idempotent(spark):
    chapters = spark.createDataFrame([(1, "x", n, f"Body {n}") for n in (1, 2, 4)], "novel_id long, name string, num long, content string")
    _, once = L.rebuild_index_and_nav(chapters)
    again_in = once.withColumn("name", F.lit("x"))
    _, twice = L.rebuild_index_and_nav(again_in)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    middle = once.filter("num = 2").first()["content"]
    assert "|← Ch 1]]" in middle and "|Ch 4 →]]" in middle


def test_blog_payload_without_body_fails(spark):
    pending = spark.createDataFrame([("a", "u1", "blog"), ("b", "u2", "blog")], "slug string, url string, content_type string")
    body = '{"result":{"data":{"drupal":{"article":{"title":"T","body":{"processed":"<p>%s</p>"}}}}}}' % ("word " * 40)
    payloads = spark.createDataFrame([("u1", body)], "url string, body string")
    read = blogs.read_payloads(pending, payloads, F.lit("2024-05-06"))
    rows = {r["slug"]: r for r in read.collect()}
    assert rows["a"]["reject"] is None and rows["a"]["file_path"] == "Databricks/T.md"
    assert rows["b"]["reject"] == "no content"
    ledger = pending.withColumns({"status": F.lit("pending"), "title": F.lit(None).cast("string")})
    after = {r["slug"]: r["status"] for r in blogs.record_run(ledger, read, F.current_timestamp()).collect()}
    assert after == {"a": "downloaded", "b": "failed"}


def test_novel_sync_only_takes_newer(spark):
    names = spark.createDataFrame([(1, "my novel")], "novel_id long, name string")
    available = spark.createDataFrame([(1, n, f"Chapter {n}") for n in range(1, 6)], "novel_id long, num long, title string")
    local = spark.createDataFrame([(1, 3, "Chapter 3", 9)], "novel_id long, num long, title string, char_count long")
    fetched = spark.createDataFrame([(1, 4, "x" * 60), (1, 5, "short")], "novel_id long, num long, content string")
    done = novels.sync_chapters(names, available, local, fetched)
    assert [r["path"] for r in done["notes"].collect()] == ["My Novel/0004 - My Novel.md"]
    assert tuple(done["log"].first()) == (1, 2, 1, "partial")
    assert sorted(r["num"] for r in done["ledger"].collect()) == [3, 4]
    missing = novels.sync_chapters(names, available, local, fetched, mode="missing")
    assert missing["log"].first()["new_found"] == 4


def test_bookmark_discovery_routes_only_new(spark):
    items = spark.createDataFrame(
        [(1, "https://medium.com/@u/p-1", "t"), (2, "https://medium.com/@u/p-2", "t"), (3, "https://x.com/a", "t")],
        "raindrop_id long, url string, title string")
    ledger = spark.createDataFrame([(1,)], "raindrop_id long")
    feed = spark.createDataFrame([("p-9",)], "slug string")
    kept, routed = bookmarks.discover_bookmarks(items, ledger, feed)
    assert {r["raindrop_id"]: r["status"] for r in kept.collect()} == {2: "skipped_medium", 3: "pending"}
    assert [(r["slug"], r["username"]) for r in routed.collect()] == [("p-2", "u")]


def _files(folder):
    return {str(f.relative_to(folder)): (f.stat().st_size, f.stat().st_mtime_ns) for f in folder.rglob("*.parquet")}


def test_change_reads_and_writes_its_buckets_only(spark, tmp_path, monkeypatch):
    rows = spark.range(4000).select(F.col("id"), F.concat(F.lit("t"), F.col("id")).alias("title"), F.lit(None).cast("long").alias("n"))
    ledger = KeyedTable(spark, str(tmp_path / "ledger"), ["id"], buckets=32)
    ledger.create(rows)
    before, opened, read = _files(tmp_path / "ledger"), [], ledger.read

    def noted(buckets=None):
        found = read(buckets)
        opened.extend(r[0] for r in found.select(F.input_file_name()).distinct().collect())
        assert "PartitionFilters: [bucket#" in found._jdf.queryExecution().executedPlan().toString()
        return found

    monkeypatch.setattr(ledger, "read", noted)
    incoming = spark.createDataFrame([(7, "seven", None), (9000, "new", 5)], "id int, title string, n long")  # an int here, a long there
    touched = ledger.upsert(incoming, ["title", "n"])
    monkeypatch.undo()
    after = _files(tmp_path / "ledger")
    assert 1 <= len(touched) <= 2 and {f.split("bucket=")[1].split("/")[0] for f in opened} <= {str(b) for b in touched}
    held = [f for f in before if int(f.split("=")[1].split("/")[0]) not in touched]
    assert len(held) >= 30 and all(before[f] == after[f] for f in held)
    assert sum(before[f][0] for f in before if f not in held) < sum(s for s, _ in before.values()) / 8
    found = {r.id: (r.title, r.n) for r in ledger.read().collect()}
    assert len(found) == 4001 and found[7] == ("seven", None) and found[9000] == ("new", 5) and found[8] == ("t8", None)
    assert ledger.upsert(incoming, ["title", "n"]) == touched and {r.id: (r.title, r.n) for r in ledger.read().collect()} == found
    assert ledger.upsert(incoming.where("false"), ["title", "n"]) == []


def test_failed_change_leaves_the_table(spark, tmp_path):
    ledger = KeyedTable(spark, str(tmp_path / "ledger"), ["id"], buckets=4)
    ledger.create(spark.range(100).withColumn("v", F.lit("x")))
    before = _files(tmp_path / "ledger")
    with pytest.raises(Exception, match="broken"):
        ledger.change(spark.range(50), lambda old, new: old.withColumn("v", F.when(F.col("id") == 3, F.raise_error(F.lit("broken"))).otherwise("y")))
    assert _files(tmp_path / "ledger") == before
