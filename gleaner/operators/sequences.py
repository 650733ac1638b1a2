"""Ordered operators: first of a key, neighbours, running values, numbering.

A group may hold a large share of all rows and its numbers may be sparse, so no operator sorts a whole
group in one task. Rows are cut by rank into range partitions (``segments``), windows run inside a
partition, and what a group hands on to the next partition comes from two rows a partition at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import notes as N
from gleaner.functions import text as T
from gleaner.session import checkpoint_dir, written

def dedup_first(entries: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key in encounter order; of equal orders the least by a hash of the row.

    Repeats merge before the shuffle. Where rows hold more than key and order they are written once with a row
    number; keys, orders and numbers alone are reduced, and only the first rows' other columns are fetched.
    """
    rest = [c for c in entries.columns if c not in [*keys, *order]]
    if not rest and len(order) == 1:
        return entries.groupBy(*keys).agg(F.min(order[0]).alias(order[0])).select(*entries.columns)
    if not rest:
        first = entries.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
        return first.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in entries.columns])
    rows, first = first_rows(entries, keys, order)
    return fetch_rows(rows, first)


def first_rows(entries: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(rows, first)``: the written entries with ``_row``, and the keys with the ``_row`` of their first entry."""
    rest = [c for c in entries.columns if c not in [*keys, *order]]
    rows = written(entries.withColumns({"_tie": F.xxhash64(*rest), "_row": F.monotonically_increasing_id()}), "entries")
    return rows, rows.groupBy(*keys).agg(F.min(F.struct(*order, "_tie", "_row")).alias("_first")).select(*keys, "_first._row")


def fetch_rows(rows: DataFrame, first: DataFrame) -> DataFrame:
    """The written rows that ``first`` numbers; a row number spreads evenly, whatever its key."""
    return rows.join(first.select("_row"), "_row", "left_semi").drop("_tie", "_row")


def segments(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows in partitions of about equal size that follow each other in the order of ``by``; ``_part`` numbers them.

    The partitions are cut by rank, so that sparse keys such as hashes spread like dense ones and a hot
    group spreads over as many partitions as its share. The ranges are written once, as all uses must see the
    same ones; windows by ``_part`` and any other column need no further shuffle.
    """
    checkpoint_dir(rows.sparkSession)
    ranged = rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()).checkpoint()
    last = ranged.agg(F.max("_part")).first()[0]
    return ranged.repartitionById((last or 0) + 1, "_part")


def _border_groups(cut: DataFrame, group: list[str], **summaries: Column) -> DataFrame:
    """Summaries of the first and the last group of each partition, the only ones that other partitions share."""
    found = cut.groupBy("_part", *group).agg(*[c.alias(n) for n, c in summaries.items()])
    whole, inside = F.struct(*group), Window.partitionBy("_part")
    ends = found.withColumns({"_first": F.min(whole).over(inside), "_final": F.max(whole).over(inside)})
    return ends.where(whole.eqNullSafe(F.col("_first")) | whole.eqNullSafe(F.col("_final"))).drop("_first", "_final")


def _join_borders(rows: DataFrame, borders: DataFrame, group: list[str]) -> DataFrame:
    """Rows with what their group gets from other partitions; ``borders`` has two rows a partition at most."""
    keys = ["_part", *group]
    renamed = F.broadcast(borders.withColumnsRenamed({k: f"_of_{k}" for k in keys}))
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(renamed[f"_of_{k}"]) for k in keys])
    return rows.join(renamed, same, "left")


def neighbours(rows: DataFrame, group: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Add ``prev_*`` and ``next_*`` of the columns in the group's order; a null is a group of its own."""
    value, position = F.struct(*[F.col(c) for c in columns]), F.struct(*[F.col(c) for c in order])
    cut = segments(rows, [*group, *order])
    inside = Window.partitionBy("_part", *group).orderBy(*order)
    linked = cut.withColumns({"_prev": F.lag(value).over(inside), "_next": F.lead(value).over(inside)})
    ends = _border_groups(cut, group, first=F.min_by(value, position), last=F.max_by(value, position))
    across = Window.partitionBy(*group).orderBy("_part")
    borders = ends.select(
        "_part", *group, F.lag("last").over(across).alias("_before"), F.lead("first").over(across).alias("_after"))
    joined = _join_borders(linked, borders, group)
    before, after = F.coalesce("_prev", "_before"), F.coalesce("_next", "_after")
    return joined.select(
        *rows.columns,
        *[before[c].alias(f"prev_{c}") for c in columns],
        *[after[c].alias(f"next_{c}") for c in columns],
    )


def carry_forward(rows: DataFrame, group: list[str], order: list[str], value: str, into: str) -> DataFrame:
    """Add the last non-null ``value`` at or before each row of the group."""
    cut = segments(rows, [*group, *order])
    inside = (
        Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    running = cut.withColumn("_running", F.last(value, ignorenulls=True).over(inside))
    position = F.when(F.col(value).isNotNull(), F.struct(*order))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = _border_groups(cut, group, _last=F.max_by(value, position)).select(
        "_part", *group, F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    return _join_borders(running, carried, group).select(*rows.columns, F.coalesce("_running", "_carried").alias(into))


def number_rows(rows: DataFrame, order: str, into: str) -> DataFrame:
    """Dense numbers from 1 over all rows, by a unique key: counts per range partition, then inside partitions."""
    ranged = segments(rows, [order])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    return ranked.join(starts, "_part").select(*rows.columns, (F.col("_start") + F.col("_rank")).alias(into))


def assign_ids(new: DataFrame, ledger: DataFrame, order: str) -> DataFrame:
    """Give new rows the ids after the ledger's highest, in encounter order."""
    highest = ledger.agg(F.coalesce(F.max("id"), F.lit(0)).alias("high")).scalar()
    numbered = number_rows(new, order, "_id")
    return numbered.withColumn("id", F.col("_id") + highest).drop("_id")


def ordinal_lines(items: Column, ordered: bool = True) -> Column:
    """List items as lines; blank items give no line but are counted."""
    numbered = F.transform(
        items,
        lambda text, i: F.struct(
            T.strip(text).alias("text"),
            (F.concat((i + 1).cast("string"), F.lit(". ")) if ordered else F.lit("- ")).alias("mark")),
    )
    kept = F.filter(numbered, lambda x: x["text"] != "")
    return F.transform(kept, lambda x: F.concat(x["mark"], x["text"]))


def first_by_priority(*candidates: tuple[Column, Column]) -> Column:
    """Value of the first ``(gate, value)`` whose gate holds."""
    return F.coalesce(*[F.when(gate, value) for gate, value in candidates])


def skip_leading_headers(rows: DataFrame, group: list[str], num: str, is_header: Column) -> DataFrame:
    """Rows of each group from the first one that is no header."""
    marked = rows.withColumn("_other", F.when(~is_header, True))
    reached = carry_forward(marked, group, [num], "_other", "_reached")
    return reached.filter("_reached").drop("_other", "_reached")


def chapter_nav(chapters: DataFrame) -> DataFrame:
    """``(novel_id, num, prev_num, next_num, footer)`` for ``chapters(novel_id, name, num)``."""
    linked = neighbours(chapters.select("novel_id", "name", "num"), ["novel_id"], ["num"], ["num"])
    footer = N.nav_footer(T.folder_name("name"), "prev_num", "next_num")
    return linked.select("novel_id", "num", "prev_num", "next_num", footer.alias("footer"))


def index_lines(chapters: DataFrame) -> DataFrame:
    """Index entries ``(novel_id, ord, line)``: one head per novel, one line per chapter.

    The form is the same at every length; ``write_line_files`` makes one index of each novel.
    """
    folder, tag = T.folder_name("name"), T.kebab_case("name")
    heads = chapters.groupBy("novel_id").agg(F.min("name").alias("name")).select(
        "novel_id", F.lit(-1).cast("long").alias("ord"),
        N.index_head(folder, tag).alias("line"))
    lines = chapters.select(
        "novel_id", F.col("num").cast("long").alias("ord"), N.toc_line(folder, "num").alias("line"))
    return heads.unionByName(lines)


def series_nav(posts: DataFrame, min_parts: int = 2) -> DataFrame:
    """Navigation block of every post whose title names a part of a series of two or more.

    ``posts(id, title)``; order is the part number, then the id.
    """
    found = T.one_if(T.series_part("title"), lambda s: s.isNotNull())
    parts = posts.select("id", "title", found.alias("s")).select(
        "id", "title", F.col("s.base").alias("base"), F.col("s.part").cast("long").alias("part"))
    linked = neighbours(parts, ["base"], ["part", "id"], ["id", "title"])
    # A series of one has neither neighbour; with min_parts 2 that is the whole test.
    multi = F.col("prev_id").isNotNull() | F.col("next_id").isNotNull()
    kept = linked.filter(multi) if min_parts >= 2 else linked
    if min_parts > 2:
        from gleaner.operators.aggregates import series_groups
        from gleaner.operators.joins import join_per_parent

        groups = series_groups(parts, "base", min_parts).select("base")
        kept = join_per_parent(linked, groups, ["base"], ["id"], "inner")
    block = N.series_nav("prev_title", "next_title")
    return kept.select("id", "base", "part", "prev_title", "next_title", block.alias("block"))
