"""Mixtures against the target weights themselves, with hot, unlisted and very many sources."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.llm.mixing import mix


def check(rows, sizes, weights, block_rows, bound):
    assert len(rows) == sum(sizes.values())
    assert sorted(r.position for r in rows) == list(range(len(rows)))
    slots = {(r.source, r.block): r.slot for r in rows}
    assert len(set(slots.values())) == len(slots)
    assert [r.slot for r in sorted(rows, key=lambda r: r.position)] == sorted(r.slot for r in rows)
    last = Counter()
    for (s, _), slot in slots.items():
        last[s] = max(last[s], slot)
    total, had, owner = sum(weights.values()), Counter(), {v: s for (s, _), v in slots.items()}
    for slot in range(min(last[s] for s in weights) + 1):
        had[owner[slot]] += 1
        for s, w in weights.items():
            assert abs(had[s] - (slot + 1) * w / total) < bound(w / total), (s, slot)


def table(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, n long")
    return rows.select("source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).select(
        F.xxhash64("source", "i").alias("doc_id"), "source")


@pytest.mark.parametrize("sizes,targets", [
    ({"hot": 17_000, **{f"s{i:02}": 1_800 for i in range(19)}}, None),
    ({"a": 6_000, "b": 3_000, "c": 1_000, "d": 40}, {"a": 6, "b": 3, "c": 1}),
])
def test_deviation_from_target_weights(spark, sizes, targets):
    weights = targets or {s: math.sqrt(n) for s, n in sizes.items()}
    rows = mix(table(spark, sizes), targets, block_rows=1).collect()
    check(rows, sizes, weights, 1, lambda w: 3)
    if targets:
        assert min(r.position for r in rows if r.source == "d") == 10_000


def test_more_sources_than_a_period_has_slots(spark):
    sizes = {"hot": 900, **{f"s{i}": 2 for i in range(1_500)}}
    rows = mix(table(spark, sizes), block_rows=1).collect()
    check(rows, sizes, {s: math.sqrt(n) for s, n in sizes.items()}, 1, lambda w: 2 + math.log2(1 / w))
