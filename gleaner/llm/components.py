"""Connected components of an edge table.

Each task first merges the edges of its own partition by union-find, which leaves one edge a node.
While the edges need more than one task, alternating large-star and small-star steps bring the
parts together: a minimum per node and a join each, so that no component is gathered in one place.
What is left after a round is written to the shared folder; a lost executor costs one round.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Edges that one task merges in its memory.
EDGES_PER_TASK = 500_000


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as (node, smallest node that it reaches here)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (above := root.setdefault(top, top)) != top:
            top = above
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(n) for n in nodes], pa.int64())], ["hi", "lo"])


def _star(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v): give every v of u the least node that u knows."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least.withColumn("m", F.least("u", "m")), "u")


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    large = _star(both).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    down = large.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    small = _star(down).select(
        F.explode(F.array(F.struct(F.col("u").alias("hi"), F.col("m").alias("lo")),
                          F.struct(F.col("v").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*")
    return small.where("hi <> lo").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs to (node, component): the smallest node of each component.

    Only nodes with an edge to another node come back. Null ends and loops are ignored;
    repeated edges count once; an empty table gives an empty table.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")), "edges")
    state = None
    while True:
        # sum and xor of hashes: equal on equal edge sets, so the loop ends when a round changes nothing
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        tasks = -(-seen.n // EDGES_PER_TASK)
        merged = now.coalesce(max(tasks, 1)).mapInArrow(_merge, "hi long, lo long")
        if tasks <= 1:
            return staged(merged.select(F.col("hi").alias("node"), F.col("lo").alias("component")), "components")
        if seen == state:
            return staged(now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
                now.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).distinct(), "components")
        state = seen
        now = staged(_round(merged.where("hi <> lo")), "edges")
