"""Ordered operators against brute force, with partitions far smaller than the groups."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import aggregates as A
from gleaner.operators import offsets as O
from gleaner.operators import sequences as Q


@pytest.fixture
def cut_into(spark):
    """Let shuffles have as many partitions as a test says, though its rows are few."""
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"]
    before = [spark.conf.get(n) for n in names]

    def set_to(partitions):
        spark.conf.set(names[0], partitions)
        spark.conf.set(names[1], False)

    yield set_to
    for n, value in zip(names, before):
        spark.conf.set(n, value)


@pytest.fixture
def hot(spark):
    """One group with a third of all rows, gaps in the numbers, many small groups."""
    rng = random.Random(7)
    rows = [("hot", n) for n in rng.sample(range(1, 900), 300)]
    rows += [(f"g{i}", n) for i in range(60) for n in rng.sample(range(1, 50), 10)]
    return rows, spark.createDataFrame(rows, "g string, num long")


def _groups(rows):
    out = {}
    for g, n in rows:
        out.setdefault(g, []).append(n)
    return {g: sorted(ns) for g, ns in out.items()}


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_neighbours(hot, cut_into, partitions):
    rows, frame = hot
    cut_into(partitions)
    found = {
        (r["g"], r["num"]): (r["prev_num"], r["next_num"])
        for r in Q.neighbours(frame, ["g"], ["num"], ["num"]).collect()
    }
    want = {}
    for g, ns in _groups(rows).items():
        for before, n, after in zip([None, *ns], ns, [*ns[1:], None]):
            want[(g, n)] = (before, after)
    assert found == want


def test_neighbours_with_equal_order_values(spark, cut_into):
    cut_into(6)
    rows = [("s", 1, i) for i in range(40)] + [("s", 2, i) for i in range(100, 120)] + [("t", 1, 500)]
    frame = spark.createDataFrame(rows, "g string, part long, id long")
    linked = Q.neighbours(frame, ["g"], ["part", "id"], ["id"])
    found = {r["id"]: (r["prev_id"], r["next_id"]) for r in linked.collect()}
    ids = [i for g, _, i in sorted(rows) if g == "s"]
    want = dict(zip(ids, zip([None, *ids], [*ids[1:], None])))
    assert found == {**want, 500: (None, None)}


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_carry_forward(hot, spark, cut_into, partitions):
    rows, _ = hot
    cut_into(partitions)
    rng = random.Random(3)
    valued = [(g, n, rng.choice([None, None, n * 10])) for g, n in rows]
    frame = spark.createDataFrame(valued, "g string, num long, v long")
    found = {
        (r["g"], r["num"]): r["last"]
        for r in Q.carry_forward(frame, ["g"], ["num"], "v", "last").collect()
    }
    want, last = {}, {}
    for g, n, v in sorted(valued, key=lambda r: (r[0], r[1])):
        last[g] = v if v is not None else last.get(g)
        want[(g, n)] = last[g]
    assert found == want


def test_value_carried_over_whole_partitions(spark, cut_into):
    cut_into(12)
    frame = spark.createDataFrame([("g", n, 5 if n == 3 else None) for n in range(400)] + [("h", n, None) for n in range(50)], "g string, num long, v long")
    found = {(r["g"], r["num"]): r["last"] for r in Q.carry_forward(frame, ["g"], ["num"], "v", "last").collect()}
    assert found == {**{("g", n): 5 if n >= 3 else None for n in range(400)}, **{("h", n): None for n in range(50)}}


def test_sparse_numbers_of_a_hot_group_spread(spark, cut_into):
    cut_into(8)
    key = F.col("id") * 2654435761 % 4294967291
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("g"), key.alias("num"))
    sizes = [r["count"] for r in Q.segments(rows, ["g", "num"]).groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * 60_000 / 8
    linked = Q.neighbours(rows, ["g"], ["num"], ["num"])
    held = linked.groupBy(F.spark_partition_id()).count().collect()  # windows and joins leave the rows where they were cut
    assert len(held) == 8 and max(r["count"] for r in held) <= 2 * 60_000 / 8
    plan = linked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange shufflepartitionidpassthrough") == 2 and "hashpartitioning(_part" not in plan


def test_null_groups_and_numbers_stay(spark, cut_into):
    cut_into(3)
    rows = [("a", 1), ("a", 2), ("a", None), (None, 1), (None, 5)]
    frame = spark.createDataFrame(rows, "g string, num long")
    linked = Q.neighbours(frame, ["g"], ["num"], ["num"]).collect()
    assert sorted(map(repr, ((r["g"], r["num"]) for r in linked))) == sorted(map(repr, rows))
    assert {r["num"]: r["next_num"] for r in linked if r["g"] is None} == {1: 5, 5: None}
    carried = Q.carry_forward(frame, ["g"], ["num"], "num", "last")
    assert carried.count() == len(rows)


def test_number_rows_is_dense(spark):
    rng = random.Random(5)
    keys = rng.sample(range(10_000), 500)
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    found = {r["k"]: r["id"] for r in Q.number_rows(frame, "k", "id").collect()}
    assert found == {k: i for i, k in enumerate(sorted(keys), 1)}


def test_assign_ids_to_empty_ledger(spark):
    new = spark.createDataFrame([("b", 2), ("a", 1)], "slug string, ord long")
    ledger = spark.createDataFrame([], "id long, slug string")
    found = {r["slug"]: r["id"] for r in Q.assign_ids(new, ledger, "ord").collect()}
    assert found == {"a": 1, "b": 2}


def test_dedup_first_keeps_first_and_all_keys(spark):
    rows = [("hot", i, f"v{i}") for i in range(200, 0, -1)] + [(f"k{i}", i, "x") for i in range(50)]
    frame = spark.createDataFrame(rows, "k string, ord long, v string")
    found = {r["k"]: r["v"] for r in Q.dedup_first(frame, ["k"], ["ord"]).collect()}
    assert found["hot"] == "v1" and len(found) == 51


def test_skip_leading_headers(spark):
    kinds = {"a": "HHPHP", "b": "PHH", "c": "HHH"}
    rows = [(g, i, k) for g, ks in kinds.items() for i, k in enumerate(ks)]
    frame = spark.createDataFrame(rows, "g string, num long, kind string")
    kept = Q.skip_leading_headers(frame, ["g"], "num", F.col("kind") == "H")
    assert sorted((r["g"], r["num"]) for r in kept.collect()) == [("a", 2), ("a", 3), ("a", 4), ("b", 0), ("b", 1), ("b", 2)]


def test_series_nav_of_three_or_more(spark):
    titles = ["A: Part 1", "A: Part 2", "B: Part 1", "B: Part 2", "B: Part 3", "C: Part 1"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "id long, title string")
    assert {r["id"] for r in Q.series_nav(frame).collect()} == {0, 1, 2, 3, 4}
    assert {r["id"] for r in Q.series_nav(frame, min_parts=3).collect()} == {2, 3, 4}


def test_index_is_one_run_of_lines(spark):
    rows = [(1, "my novel", n) for n in [1, 2, 9_999, 10_000, 10_001]]
    lines = [r["line"] for r in Q.index_lines(spark.createDataFrame(rows, "novel_id long, name string, num long")).orderBy("ord").collect()]
    assert lines[0].startswith("---\ntags:") and len(lines) == 6
    assert lines[3:5] == ["- [[9999 - My Novel|Chapter 9999]]", "- [[10000 - My Novel|Chapter 10000]]"]


@pytest.mark.parametrize("k", [1, 3])
def test_detect_offset_preference(spark, k):
    rng = random.Random(11)
    observed = [("n", u, rng.randint(1, 12)) for u in range(1, 30)]
    targets = [("n", t) for t in range(1, 14)]
    frame = O.detect_offset(
        spark.createDataFrame(targets, "novel string, num long"),
        spark.createDataFrame(observed, "novel string, url_n long, actual long"), k=k)
    found = {r["num"]: r["offset"] for r in frame.collect()}
    at = {u: a for _, u, a in observed}
    for _, target in targets:
        tries = [0, *range(1, k + 1), *range(-1, -k - 1, -1)]
        want = next((o for o in tries if target + o > 0 and at.get(target + o) == target), None)
        assert found[target] == want


def test_asof_offset(spark):
    mapped = [("n", 5, 1), ("n", 12, -2), ("m", 3, 4)]
    asked = [(n, i) for n in ("n", "m", "o") for i in range(1, 20)]
    frame = O.asof_offset(
        spark.createDataFrame(asked, "novel string, num long"),
        spark.createDataFrame(mapped, "novel string, chapter long, offset long"))
    for row in frame.collect():
        fits = [(c, o) for n, c, o in mapped if n == row["novel"] and c <= row["num"]]
        assert row["offset"] == (max(fits)[1] if fits else 0)
        assert row["url_num"] == row["num"] + row["offset"]
