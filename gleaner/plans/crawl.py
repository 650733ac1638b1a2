"""Crawled pages straight to a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import values as V
from gleaner.functions import html as H
from gleaner.functions import text as T
from gleaner.functions import urls as U
from gleaner.operators.documents import chapter_text
from gleaner.operators.selection import quality_gate


def read_pages(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` to rows with title, slug, text, counts and status."""
    text = chapter_text("html", V.BOILERPLATE["freewebnovel.com"], selectors=("article", "main", "body"))
    rows = pages.select(
        "page_id", "url", "html", U.host("url").alias("host"), U.slug_path("url", drop_html=True).alias("slug"),
        H.page_meta("html")["title"].alias("title"), text.alias("content"))
    gated = quality_gate(rows, html="html").drop("html")
    return gated.select(
        "page_id", "url", "host", "slug", U.parent_path("slug").alias("parent_path"), "title", "content",
        T.word_count("content").alias("word_count"), T.char_count("content").alias("char_count"),
        F.when(F.col("reject").isNull(), V.DOWNLOADED).otherwise(V.FAILED).alias("status"), "reject")


def crawl_report(pages: DataFrame) -> DataFrame:
    """Pages and words per host and status, with totals (``*``)."""
    rows = read_pages(pages).groupBy("host", "status").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("word_count").alias("words"))
    return rows.rollup("host", "status").agg(
        F.when(F.grouping("host") == 1, "*").otherwise(F.col("host")).alias("_host"),
        F.when(F.grouping("status") == 1, "total").otherwise(F.col("status")).alias("_status"),
        F.sum("pages").alias("pages"), F.sum("words").alias("words"),
    ).select(F.col("_host").alias("host"), F.col("_status").alias("status"), "pages", "words")
