"""Counts, progress, spans and ordered texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import values as V
from gleaner.functions.text import percent
from gleaner.operators.selection import set_columns


def status_counts(ledger: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows per status, with a ``total`` per group and over all groups.

    The ledger is counted once; totals come from the handful of counts.
    """
    by = by or []
    counts = ledger.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n"))
    keys = [F.when(F.grouping(c) == 1, "*").otherwise(F.col(c)).alias(c) for c in by]
    status = F.when(F.grouping("status") == 1, "total").otherwise(F.col("status")).alias("status")
    return counts.rollup(*by, "status").agg(
        *[k.alias(f"_{c}") for k, c in zip(keys, by)], status.alias("_status"), F.sum("n").alias("count")
    ).select(*[F.col(f"_{c}").alias(c) for c in by], F.col("_status").alias("status"), "count")


def progress(ledger: DataFrame, by: str) -> DataFrame:
    """Total, downloaded, failed, pending and percentage done, per value and over all (``*``)."""
    def is_status(name: str) -> Column:
        return F.count_if(F.col("status") == name)

    groups = ledger.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), is_status(V.DOWNLOADED).alias("downloaded"),
        is_status(V.FAILED).alias("failed"), is_status(V.PENDING).alias("pending"))
    summed = groups.rollup(by).agg(
        F.when(F.grouping(by) == 1, "*").otherwise(F.col(by)).alias("_by"),
        *[F.sum(c).alias(c) for c in ("total", "downloaded", "failed", "pending")])
    return summed.filter(F.col("total") > 0).select(
        F.col("_by").alias(by), "total", "downloaded", "failed", "pending",
        percent(F.col("downloaded"), F.col("total")).alias("pct"))


def latest_num(parents: DataFrame, children: DataFrame, key: str, num: str) -> DataFrame:
    highest = children.groupBy(key).agg(F.max(num).alias("latest"))
    return parents.select(key).join(highest, key, "left").select(
        key, F.coalesce("latest", F.lit(0)).alias("latest"))


def reset_failed(ledger: DataFrame, source: str | None = None) -> DataFrame:
    """Failed rows back to pending, their errors cleared."""
    where = F.col("status") == V.FAILED
    if source:
        where = where & (F.col("source") == source)
    errors = {c: None for c in ("error_reason", "error_detail", "error_html") if c in ledger.columns}
    cleared = set_columns(ledger.withColumn("_reset", where), F.col("_reset"), ["status", *errors], status=V.PENDING, **errors)
    return cleared.drop("_reset")


def count_status(ledger: DataFrame, status: str = V.PENDING) -> DataFrame:
    return ledger.agg(F.count_if(F.col("status") == status).alias("count"))


def run_summary(ledger: DataFrame, by: list[str]) -> DataFrame:
    """Totals of a run; ``success`` without failures, else ``partial``."""
    failed = F.count_if(F.col("status") == V.FAILED)
    return ledger.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == V.DOWNLOADED).alias("downloaded"),
        failed.alias("failed"), F.when(failed == 0, "success").otherwise("partial").alias("status"))


def total_new(checks: DataFrame) -> DataFrame:
    """How many parents have new items, and how many items that makes."""
    return checks.filter(F.col("new") > 0).agg(
        F.count(F.lit(1)).alias("parents"), F.coalesce(F.sum("new"), F.lit(0)).alias("total_new"))


def series_groups(parts: DataFrame, base: str, min_parts: int = 2) -> DataFrame:
    return parts.groupBy(base).agg(F.count(F.lit(1)).alias("parts")).filter(F.col("parts") >= min_parts)


def group_span(rows: DataFrame, key: str, num: str) -> DataFrame:
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("count"), F.min(num).alias("first"), F.max(num).alias("last"))


def join_in_order(parts: DataFrame, keys: list[str], order: str, text: str, sep: str, into: str) -> DataFrame:
    """Texts of a group joined by their order.

    The keys must bound the group: long sequences carry a page number in their keys,
    so that the pages one after the other make the whole text.
    """
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda x: x["t"]), sep).alias(into))


def distinct_sites(rows: DataFrame, column: str = "source") -> DataFrame:
    return rows.select(column).distinct()


def pipeline_summary(steps: DataFrame, sites_pipeline: str = "Docs") -> DataFrame:
    """One line ``A: s | B: s`` from ``steps(pipeline, ord, outcome)``.

    A pipeline is done if every step is ok, else a configuration error beats a
    failure. In the one that loops over sites the configuration error goes first.
    """
    failed = F.count_if(F.col("outcome") != "ok") > 0
    config = F.count_if(F.col("outcome") == "config_error") > 0
    many = F.col("pipeline") == sites_pipeline
    status = (
        F.when(many & config, "config_error").when(~failed, "done")
        .when(config, "config_error").otherwise("failed"))
    per = steps.groupBy("pipeline").agg(F.min("ord").alias("ord"), status.alias("status"))
    line = F.concat(F.col("pipeline"), F.lit(": "), F.col("status"))
    # One entry per pipeline: the list has as many entries as there are pipelines.
    return per.agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), " | ")
        .alias("summary"))
