"""Shifted chapter numbers: which URL number holds a chapter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.sequences import carry_forward


def asof_offset(chapters: DataFrame, offset_map: DataFrame) -> DataFrame:
    """``chapters(novel, num)`` with the offset of the greatest mapped chapter at or below it, else 0.

    Map rows and chapters go through one running value; at equal numbers the map goes first.
    """
    asked = chapters.select(
        "novel", "num", F.lit(None).cast("long").alias("known"), (F.col("num") * 2 + 1).alias("at"))
    mapped = offset_map.select(
        "novel", F.col("chapter").alias("num"), F.col("offset").cast("long").alias("known"),
        (F.col("chapter") * 2).alias("at"))
    running = carry_forward(mapped.unionByName(asked), ["novel"], ["at"], "known", "offset")
    offset = F.coalesce("offset", F.lit(0))
    return running.filter("at % 2 = 1").select(
        "novel", "num", offset.alias("offset"), (F.col("num") + offset).alias("url_num"))


def detect_offset(targets: DataFrame, observed: DataFrame, k: int = 10) -> DataFrame:
    """Offset at which each target chapter was observed: 0, +1..+k, then -1..-k.

    The observed number equals the target, so the range test needs the observed row
    alone and goes before the join: at most 2k + 1 rows per chapter are left, and
    the best of them is found before the shuffle ends.
    """
    distance = F.col("url_n") - F.col("actual")
    preference = F.when(distance >= 0, distance).otherwise(F.lit(k) - distance)
    best = (
        observed.filter((F.col("url_n") > 0) & (F.abs(distance) <= k))
        .groupBy("novel", F.col("actual").alias("num")).agg(F.min_by(distance, preference).alias("offset"))
    )
    return targets.join(best, ["novel", "num"], "left")


def offset_report(offsets: DataFrame, part: Column) -> DataFrame:
    """JSON report per novel and part of its chapters (``part`` bounds a report's size)."""
    pair = F.struct(F.col("chapter").cast("string").alias("k"), F.col("offset").alias("v"))
    entries = F.sort_array(F.collect_list(F.struct(F.col("chapter"), pair.alias("e"))))
    body = F.struct(
        F.col("novel").cast("string").alias("novel"),
        F.map_from_entries(F.transform(entries, lambda x: x["e"])).alias("offset_map"))
    return offsets.withColumn("part", part).groupBy("novel", "part").agg(F.to_json(body).alias("report"))


def offset_summary(runs: DataFrame) -> DataFrame:
    """Per novel and part: its offsets in order, and how many chapters were found.

    ``runs(novel, part, num, offset)``, a null offset being a failure.
    """
    line = F.format_string("%d:%d:%d", "num", "offset", F.col("num") + F.col("offset"))
    entries = F.sort_array(F.collect_list(F.when(F.col("offset").isNotNull(), F.struct("num", line.alias("l")))))
    return runs.groupBy("novel", "part").agg(
        F.count("offset").alias("success"), F.count_if(F.col("offset").isNull()).alias("failed"),
        F.array_join(F.transform(entries, lambda x: x["l"]), ",").alias("offsets"))
