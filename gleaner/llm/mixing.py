"""Mixing sources to target weights by a Pfair schedule.

Time is a row of slots, each for one block of ``block_rows`` documents. A source with ``a`` of
``period`` parts releases its block q at slot ``q * period // a`` and must place it before
``ceil((q + 1) * period / a)``. Among released blocks the earliest deadline goes first, ties by name.
All weights are multiples of ``1 / period``, so one period repeats for ever: it is scheduled once, by
an expression over one row, and every document finds its slot from its number within its source.
At every slot each source has had less than one block more or less than its weight asks for,
until a source runs out; then its slots stay empty and the others close up.

A period rounds the weights and holds no more sources than slots. Without one, at any size, a tree is taken, which does
neither: sources lie on a line as long as their weights, halving the line
halves the sources, and each node deals its slots to its two sides in exact proportion (the left side has
had ``floor(t * L / (L + R))`` of the first t). Each block then folds its number up the path of its source, so
slots come from no state and no table of slots, for any number of sources and blocks. Each halving may add up to a block
to the deviation, times the source's share of that half: less than ``2 + log2(1 / weight)`` blocks in all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gleaner.llm.common import apart, ordinal_within

#: Slots of the period: the grain of its weights, and the bound on its sources and on the broadcast table.
PERIOD = 1000
#: Grain of the weights of the tree, and its depth: two sources always part within so many halvings.
GRAIN, DEPTH = 10**9, 31
#: Blocks that a window over numbers of slots holds at most, and rows of a source's run of blocks.
RUN = 4096
BLOCK_ROWS = 8


def source_weights(docs: DataFrame, targets: dict[str, float] | None, power: float) -> DataFrame:
    """(source, rows, weight): ``targets``, or without them a source's rows to the given power."""
    found = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    if targets is None:
        weight = F.pow(F.col("rows").cast("double"), F.lit(power))
    else:
        weight = F.coalesce(*[F.when(F.col("source") == k, F.lit(float(v))) for k, v in sorted(targets.items())], F.lit(0.0))
    return found.withColumn("weight", weight)


def source_parts(docs: DataFrame, targets: dict[str, float] | None, power: float, period: int) -> DataFrame:
    """(source, rows, parts): parts of the period by largest remainder, one at least."""
    return parts_of(source_weights(docs, targets, power), period).select("source", "rows", "parts")


def parts_of(weighted: DataFrame, period: int) -> DataFrame:
    """(source, rows, weight, parts) from (source, rows, weight)."""
    everything, ranked = Window.partitionBy(), Window.orderBy(F.desc("rest"), "source")
    total = F.sum("weight").over(everything)
    free = F.lit(period) - F.count(F.lit(1)).over(everything)
    shared = weighted.withColumn(
        "exact", F.when(total > 0, free * (F.col("weight") / total)).otherwise(F.lit(0.0)))
    floored = shared.withColumn("whole", F.floor("exact")).withColumn(
        "rest", F.round(F.col("exact") - F.col("whole"), 9))
    left = free - F.sum("whole").over(everything)
    return floored.withColumn("left", left).withColumn("place", F.row_number().over(ranked)).select(
        "source", "rows", "weight",
        (F.lit(1) + F.col("whole") + (F.col("place") <= F.col("left")).cast("int")).cast("int").alias("parts"))


def release(block: Column, parts: Column, period: int) -> Column:
    return F.floor(block * period / parts).cast("long")


def deadline(block: Column, parts: Column, period: int) -> Column:
    return F.ceil((block + 1) * period / parts).cast("long")


def schedule(parts: DataFrame, period: int) -> DataFrame:
    """One period: (source, turn, slot, parts, before), with each source's rows, parts and blocks before the slot."""
    row = parts.agg(F.array_sort(F.collect_list(F.struct("source", "rows", "parts"))).alias("all"))

    def step(state: Column, slot: Column) -> Column:
        ready = F.transform(F.col("all"), lambda s, i: F.struct(
            deadline(F.get(state["had"], i), s["parts"], period).alias("due"), i.alias("i"),
            ((F.get(state["had"], i) < s["parts"])
             & (release(F.get(state["had"], i), s["parts"], period) <= slot)).alias("open")))
        pick = F.array_min(F.filter(ready, lambda r: r["open"]))["i"]
        return F.struct(
            F.transform(state["had"], lambda n, i: n + (i == pick).cast("int")).alias("had"),
            F.concat(state["log"], F.array(F.struct(slot.alias("slot"), pick.alias("i"), state["had"].alias("had")))).alias("log"))

    start = F.struct(
        F.transform(F.col("all"), lambda s: F.lit(0)).alias("had"),
        F.array().cast("array<struct<slot:int,i:int,had:array<int>>>").alias("log"))
    run = F.aggregate(F.sequence(F.lit(0), F.lit(period - 1)), start, step, lambda s: s["log"])
    slots = row.where(F.size("all") > 0).select("all", F.inline(run))
    own = F.get("all", F.col("i"))
    return slots.select(
        own["source"].alias("source"), F.get("had", F.col("i")).cast("long").alias("turn"), F.col("slot").cast("long").alias("slot"),
        F.transform(F.arrays_zip("all", "had"), lambda z: F.struct(
            z["all"]["rows"].alias("rows"), z["all"]["parts"].alias("parts"), z["had"].alias("had"))).alias("before"))


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def paths(weighted: DataFrame) -> DataFrame:
    """(source, rows, grains, total, path): whole weights, and the halvings from the source up to the root.

    A halving is (level, side, own, both): the weights of the source's side and of both sides.
    """
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy())
    grains = weighted.withColumn("grains", F.greatest(F.lit(1), F.round(share * GRAIN)).cast("long"))
    before = F.sum("grains").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, 0)) - F.col("grains")
    placed = grains.withColumn("middle", 2 * before + F.col("grains")).withColumn(
        "total", F.sum("grains").over(Window.partitionBy()))
    levels = placed.select("source", "grains", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("level"), "middle", "total").select(
        "source", "grains", "level",
        div(F.col("middle") * F.pow(F.lit(2), F.col("level")).cast("long"), 2 * F.col("total")).alias("node"))
    sums = levels.groupBy("level", "node").agg(F.sum("grains").alias("own"))
    above = sums.select((F.col("level") + 1).alias("level"), F.col("node").alias("above"), F.col("own").alias("both"))
    halves = sums.where("level > 0").withColumn("above", div(F.col("node"), F.lit(2))).join(above, ["level", "above"]).where(
        "own < both").select("level", "node", "own", "both")
    held = levels.join(halves, ["level", "node"]).groupBy("source").agg(F.reverse(F.array_sort(F.collect_list(F.struct(
        "level", (F.col("node") % 2).alias("side"), "own", "both")))).alias("path"))
    return placed.join(held, "source", "left").select("source", "rows", "grains", "total", F.coalesce(
        "path", F.array().cast("array<struct<level:int,side:bigint,own:bigint,both:bigint>>")).alias("path"))


def tree_blocks(weighted: DataFrame, block_rows: int) -> DataFrame:
    """(source, block, release, deadline, slot, size) of every block by the tree, in tasks of a run of a source's blocks."""
    last = F.floor((F.col("rows") - 1) / block_rows)
    runs = paths(weighted).withColumn("last", last).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / RUN))))
    blocks = runs.repartition("source", "run").withColumn("block", F.explode(F.sequence(
        F.col("run") * RUN, F.least(F.col("last"), F.col("run") * RUN + RUN - 1))))
    slot = F.aggregate("path", F.col("block"), lambda q, n: F.when(
        n["side"] == 0, div((q + 1) * n["both"] - 1, n["own"])).otherwise(div(q * n["both"], n["own"])))
    return blocks.select(
        "source", "block", div(F.col("block") * F.col("total"), F.col("grains")).alias("release"),
        (div((F.col("block") + 1) * F.col("total") - 1, F.col("grains")) + 1).alias("deadline"), slot.alias("slot"),
        F.least(F.lit(block_rows), F.col("rows") - F.col("block") * block_rows).cast("long").alias("size"))


def running_rows(blocks: DataFrame) -> DataFrame:
    """Blocks with ``start``, the rows of all blocks in earlier slots: sums inside runs of slots, over runs, over runs of runs."""
    marked = blocks.withColumn("_low", div(F.col("slot"), F.lit(RUN))).withColumn("_high", div(F.col("slot"), F.lit(RUN * RUN)))

    def earlier(value: str, order: str, *group: str) -> Column:
        return F.coalesce(F.sum(value).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    low = marked.groupBy("_high", "_low").agg(F.sum("size").alias("_n"))
    high = low.groupBy("_high").agg(F.sum("_n").alias("_n")).select("_high", earlier("_n", "_high").alias("_s2"))
    low = low.select("_high", "_low", earlier("_n", "_low", "_high").alias("_s1")).join(high, "_high")
    return marked.withColumn("_s0", earlier("size", "slot", "_low")).join(low.drop("_high"), "_low").withColumn(
        "start", F.col("_s0") + F.col("_s1") + F.col("_s2")).drop("_low", "_high", "_s0", "_s1", "_s2", "size")


def mix_by_tree(docs: DataFrame, numbered: DataFrame, weighted: DataFrame, block_rows: int) -> DataFrame:
    """``mix`` by the tree; sources without a weight follow, in equal shares, when the others have run out."""
    blocks = tree_blocks(weighted.where("weight > 0"), block_rows)
    rest = weighted.where("not weight > 0").withColumn("weight", F.lit(1.0))
    if rest.count():
        end = blocks.agg(F.coalesce(F.max("slot") + 1, F.lit(0))).first()[0]
        later = tree_blocks(rest, block_rows)
        blocks = blocks.unionByName(later.select("source", "block", *[(F.col(c) + end).alias(c) for c in ("release", "deadline", "slot")], "size"))
    placed = running_rows(blocks).withColumnRenamed("source", "_source")
    return numbered.withColumn("block", F.floor(F.col("ordinal") / block_rows)).join(placed, ["_source", "block"]).select(
        *docs.columns, "block", "release", "deadline", "slot", (F.col("start") + F.col("ordinal") % block_rows).alias("position"))


def mix(docs: DataFrame, targets: dict[str, float] | None = None, power: float = 0.5, period: int | None = None,
        block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows of docs with block, release, deadline, slot and position (dense from 0, the mixed order).

    A null source counts as the source with the empty name. Documents of a source are taken in the
    order of a hash of doc_id; rows that repeat a doc_id stay neighbours. A single source keeps its own order.
    An empty table gives an empty table. The caller picks the law, never the size of the table: without a period the tree
    with the weights themselves, with one its schedule with the rounding, where more sources than slots raise. In a
    period a source without a target gets one part; in the tree it follows after the others. Other columns stay as they
    are, but for those named like the new ones.
    """
    new = ["block", "release", "deadline", "slot", "position"]
    return apart(docs, ["doc_id", "source", "text"], new, lambda rows: _mixed(rows, targets, power, period, block_rows))


def _mixed(docs: DataFrame, targets: dict[str, float] | None, power: float, period: int | None, block_rows: int) -> DataFrame:
    named = docs.withColumn("_source", F.coalesce("source", F.lit("")))
    weighted = source_weights(docs, targets, power)
    ties = [F.xxhash64("text").alias("_tie")] if "text" in docs.columns else [F.lit(0).alias("_tie")]
    numbered = ordinal_within(named.select("*", *ties), "_source", "doc_id", ["_tie"], "ordinal")
    if period is None:
        return mix_by_tree(docs, numbered, weighted, block_rows)
    parts = parts_of(weighted, period).select("source", "rows", "parts")
    sources = parts.count()
    if sources > period:
        raise ValueError(f"{sources} sources do not fit into a period of {period} slots")
    sized = numbered.join(F.broadcast(parts.select(F.col("source").alias("_source"), "parts")), "_source")
    block = F.floor(F.col("ordinal") / block_rows)
    turned = sized.withColumn("block", block).withColumn("turn", F.col("block") % F.col("parts"))
    slots = schedule(parts, period).withColumnRenamed("source", "_source")
    placed = turned.join(F.broadcast(slots), ["_source", "turn"])
    cycle = F.floor(F.col("block") / F.col("parts"))
    earlier = F.aggregate("before", F.lit(0).cast("long"), lambda n, s: n + F.least(
        s["rows"], (F.col("cycle") * s["parts"] + s["had"]) * block_rows))
    return placed.withColumn("cycle", cycle).select(
        *docs.columns, "block", release(F.col("block"), F.col("parts"), period).alias("release"),
        deadline(F.col("block"), F.col("parts"), period).alias("deadline"),
        (F.col("cycle") * period + F.col("slot")).alias("slot"),
        (earlier + F.col("ordinal") % block_rows).alias("position"))


def write_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The documents in mixed order: written as Parquet, files by number and rows within a file follow the positions."""
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select(*[F.col(f"`{c}`") for c in columns])


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents, sources weighted by the square root of their rows, in blocks of eight, by the period of ``OP3_SQL``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs, period=PERIOD)


OP3_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT coalesce(source, '') AS name, count(*) AS n FROM documents GROUP BY 1
), exact AS (
  SELECT *, ({PERIOD} - count(*) OVER ()) * (sqrt(n) / sum(sqrt(n)) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS x FROM sized
), ranked AS (
  SELECT *, floor(x) AS whole, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, name) AS place,
         {PERIOD} - count(*) OVER () - sum(floor(x)) OVER () AS spare FROM exact
), parts AS (
  SELECT name, n, (1 + whole + (place <= spare)::INT)::BIGINT AS a, row_number() OVER (ORDER BY name) AS i FROM ranked
), whole AS (SELECT list(a ORDER BY i) AS a FROM parts
), run(slot, had, pick) AS (
  SELECT -1, list_transform(a, lambda v: 0::BIGINT), NULL::BIGINT FROM whole
  UNION ALL
  SELECT slot + 1, list_transform(had, lambda v, j: v + (j = p)::BIGINT), p FROM (
    SELECT r.slot, r.had, list_min(list_filter(list_transform(w.a, lambda v, j: CASE
      WHEN r.had[j] < v AND (r.had[j] * {PERIOD}) // v <= r.slot + 1
      THEN (((r.had[j] + 1) * {PERIOD} + v - 1) // v) * 100000 + j END), lambda k: k IS NOT NULL)) % 100000 AS p
    FROM run r, whole w WHERE r.slot < {PERIOD - 1})
), slots AS (
  SELECT slot, pick AS i, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS turn FROM run WHERE slot >= 0
), numbered AS (
  SELECT doc_id, source, p.i, p.a,
         (row_number() OVER (PARTITION BY p.i ORDER BY md5(doc_id::VARCHAR), doc_id) - 1) // {BLOCK_ROWS} AS block
  FROM documents JOIN parts p ON coalesce(source, '') = p.name
), placed AS (
  SELECT doc_id, source, block, (block * {PERIOD}) // a AS release, ((block + 1) * {PERIOD} + a - 1) // a AS deadline,
         (block // a) * {PERIOD} + s.slot AS slot FROM numbered n JOIN slots s ON s.i = n.i AND s.turn = block % a
)
SELECT *, row_number() OVER (ORDER BY slot, md5(doc_id::VARCHAR), doc_id) - 1 AS position FROM placed
"""
