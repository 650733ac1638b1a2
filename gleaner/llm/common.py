"""What several operators share: staged tables, documents in, numbering inside groups, spans as text."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.session import scratch_path

#: Rows that one numbering window should hold on average.
ROWS_PER_BUCKET = 4096


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given table of documents."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def apart(docs: DataFrame, needed: list[str], new: list[str], job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``job`` over the needed columns, so that names of all others clash with nothing inside it.

    The others travel as one struct and come back behind their old names and order; ``new`` columns of the job
    follow, in place of old ones of their name.
    """
    others = [c for c in docs.columns if c not in needed]
    if not others:
        return job(docs)
    packed = docs.select(*[c for c in docs.columns if c in needed], F.struct(*[F.col(f"`{c}`") for c in others]).alias("_others"))
    back = [F.col(c) if c in needed else F.col(f"_others.`{c}`").alias(c) for c in docs.columns if c not in new]
    return job(packed).select(*back, *new)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the cluster's checkpoint folder and read it: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_order() -> Column:
    """The written order of rows read from part files: number and name of the file, part of the file, row within the part.

    Only right next to the scan. Rows that come from no file keep the order of their partitions.
    """
    name = F.substring_index(F.input_file_name(), "/", -1)
    return F.struct(
        F.coalesce(F.expr("try_cast(regexp_extract(substring_index(input_file_name(), '/', -1), '^part-([0-9]+)', 1) AS int)"), F.lit(-1)).alias("part"),
        name.alias("file"), F.input_file_block_start().alias("start"), F.monotonically_increasing_id().alias("row"))


def id_hash(key: str) -> Column:
    """A stable order of rows that does not follow the ids: md5 of the key's text, a null as empty text."""
    return F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))


def ordinal_within(rows: DataFrame, group: str, key: str, ties: list[str], into: str) -> DataFrame:
    """Number the rows of each group (not null) from 0, in the order of ``id_hash(key)``, key, ties.

    A group may hold any share of the rows: windows run inside (group, hash prefix), and the
    rows before each prefix come from counts. The number of prefixes follows the row count; the
    numbers do not depend on it. Rows equal in key and ties get neighbouring numbers in any order.
    """
    digits = max(2, math.ceil(math.log(max(rows.count() / ROWS_PER_BUCKET, 1), 16)))
    marked = rows.withColumn("_order", id_hash(key)).withColumn("_bucket", F.substring("_order", 1, digits))
    at = [group, "_bucket"]
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).select(
        *at, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*at).orderBy("_order", key, *ties)
    numbered = marked.withColumn("_rank", F.row_number().over(inside).cast("long") - 1)
    return numbered.join(starts, at).select(*rows.columns, (F.col("_start") + F.col("_rank")).alias(into))


def ordinal_in_file_order(rows: DataFrame, group: str, order: str, ties: list[str], into: str) -> DataFrame:
    """Number the rows of each group (not null) from 0, in the order of a ``file_order`` column, ties.

    A group may hold any share of the rows: windows run inside (group, run of source rows of one file), and the rows
    before each run come from counts.
    """
    at = [group, "_run"]
    marked = rows.withColumn("_run", F.col(order).withField("row", F.floor(F.col(f"{order}.row") / ROWS_PER_BUCKET)))
    before = Window.partitionBy(group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).select(
        *at, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*at).orderBy(F.col(f"{order}.row"), *ties)
    numbered = marked.withColumn("_rank", F.row_number().over(inside).cast("long") - 1)
    return numbered.join(starts, at).select(*rows.columns, (F.col("_start") + F.col("_rank")).alias(into))


def join_by_hot_key(rows: DataFrame, groups: DataFrame, key: str, share: int = 10_000) -> DataFrame:
    """Rows with the columns of their group; ``groups`` has one row per key (not null) and counts its rows in ``n``.

    Groups that hold more than one part in ``share`` of all rows, ``share`` of them at most, meet their rows
    by broadcast; the other rows are shuffled, so no task gets a larger group.
    """
    least = (groups.agg(F.sum("n")).first()[0] or 0) / share
    hot = groups.where(F.col("n") > least)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col("n") <= least), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)
