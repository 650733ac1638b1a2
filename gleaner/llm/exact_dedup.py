"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one id.

Hashes and ids are shuffled for all documents; texts only pass once, to meet the hashes that occur
more than once, and are grouped by their bytes after equal texts met in the map tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import apart


def content_hash(text: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, keep: str = "smallest", hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, copies, content_hash), a row per document.

    Texts are equal when their bytes are; a null text counts as empty. ``keep`` names the id that stays,
    ``smallest`` or ``largest``. Rows that repeat both doc_id and text are one document; ``copies``
    counts them, and so does ``group_size``. A null doc_id never stays beside an id. An empty table
    gives an empty table. ``hashed`` may be weaker: collisions are told apart by their bytes.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), hashed(text).alias("content_hash"))
    light = rows.select("doc_id", "content_hash", F.unhex(F.sha2("text", 256)).alias("sha"))
    once = light.groupBy("content_hash", "sha", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    groups = once.groupBy("content_hash").agg(
        F.sum("copies").alias("group_size"), pick("doc_id").alias("keep_id"))
    repeated = groups.where("group_size > 1").select("content_hash")
    members = rows.join(repeated, "content_hash")
    texts = members.groupBy("content_hash", "text").agg(
        F.count(F.lit(1)).alias("own_size"), pick("doc_id").alias("own_id"))
    # a list holds the different texts of one hash: one, unless hashes collide
    told = texts.groupBy("content_hash").agg(F.collect_list(F.struct(
        F.unhex(F.sha2("text", 256)).alias("sha"), "own_size", "own_id")).alias("told")).where(F.size("told") > 1)
    told = told.select("content_hash", F.inline("told"))
    found = once.join(groups, "content_hash").join(told, ["content_hash", "sha"], "left")
    size = F.coalesce("own_size", "group_size")
    stays = F.when(F.col("own_size").isNotNull(), F.col("own_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", stays.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(stays).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "copies", "content_hash")


def drop_exact_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of one document per text, all columns as they are, whatever their names; of repeated rows one stays."""
    return apart(docs, ["doc_id", "text"], [], lambda rows: _without_copies(rows, keep))


def _without_copies(docs: DataFrame, keep: str) -> DataFrame:
    found = exact_groups(docs, keep)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id")
    marked = docs.withColumn("_hash", content_hash(F.coalesce(F.col("text"), F.lit("")))).select("*", key)
    ends = [key, F.col("content_hash").alias("_hash")]
    gone = found.where("not kept or copies > 1").select(*ends)
    repeats = found.where("kept and copies > 1").select(*ends)
    single = marked.join(gone, ["_id", "_hash"], "left_anti")
    again = marked.join(repeats, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])
    return single.select(*docs.columns).union(again.select(*docs.columns))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents grouped by equal texts; the largest doc_id stays."""
    found = exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), "largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
