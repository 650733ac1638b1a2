"""Blog runs: sitemaps to pending rows, payloads to notes and a new ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import values as V
from gleaner.functions import html as H
from gleaner.functions import notes as N
from gleaner.functions import text as T
from gleaner.functions import urls as U
from gleaner.operators.joins import discover_new, first_success
from gleaner.operators.ledger import apply_outcomes
from gleaner.operators.markdown import pages_to_markdown
from gleaner.operators.selection import quality_gate, type_labels
from gleaner.session import written
from gleaner.sources.payloads import readable, typed_payloads
from gleaner.sources.sitemaps import expand_sitemaps


#: Entries in the order of a walk through the sitemaps.
ENCOUNTER = ["path", "ord", "sitemap"]


def discover_posts(docs: DataFrame, roots: DataFrame, ledger: DataFrame, keywords: list[str], prefix: str) -> DataFrame:
    """Posts of all reachable sitemaps that the ledger does not know, as pending rows."""
    entries = expand_sitemaps(docs, roots, keywords).filter(U.is_post_url("url", prefix))
    slugged = entries.select(U.slug_dated("url", prefix).alias("slug"), "url", "path", "ord", "sitemap")
    fresh = discover_new(slugged, ledger, ["slug"], ENCOUNTER)
    return fresh.select("slug", "url", F.lit("blog").alias("content_type"), "status")


def discover_glossary(docs: DataFrame, roots: DataFrame, ledger: DataFrame, prefix: str = V.GLOSSARY_PREFIX) -> DataFrame:
    """English glossary pages that the ledger does not know, as pending rows."""
    entries = expand_sitemaps(docs, roots).filter(U.english_glossary("url", prefix))
    slug = F.concat(F.lit("glossary-"), F.btrim(F.replace(F.col("url"), F.lit(prefix), F.lit("")), F.lit("/")))
    fresh = discover_new(entries.select(slug.alias("slug"), "url", "path", "ord", "sitemap"), ledger, ["slug"], ENCOUNTER)
    return fresh.select("slug", "url", F.lit("glossary").alias("content_type"), "status")


def discover_second_posts(docs: DataFrame, entry_points: list[str], ledger: DataFrame) -> DataFrame:
    """Posts of the second blog that the ledger does not know, as pending rows.

    The first entry point whose sitemaps lead to posts counts. Below an index only addresses with ``blog`` are
    followed, at an entry point without such a child all are.
    """
    spark = docs.sparkSession
    for entry in entry_points:
        roots = spark.createDataFrame([(entry,)], "url string")
        found = expand_sitemaps(docs, roots, ["blog"], fallback=True).filter(U.is_blog_url("url"))
        posts = written(found.select(U.slug_dashes("url").alias("slug"), "url", "path", "ord", "sitemap").filter("slug IS NOT NULL"), "posts")
        if not posts.isEmpty():
            break
    return discover_new(posts, ledger, ["slug"], ENCOUNTER).select("slug", "url", "status")


def read_second_posts(pending: DataFrame, pages: DataFrame, created: Column) -> DataFrame:
    """Pending posts of the second blog with their page's article, note and ``reject`` reason; ``pages(url, html)``."""
    found = pages.join(pending.select("url"), "url", "left_semi").withColumn("meta", H.page_meta("html"))
    gated = quality_gate(pages_to_markdown(found, "strict"), html="html").select("url", "meta.*", "content", "reject")
    rows = pending.join(gated, "url", "left").withColumn(
        "reject", F.when(F.coalesce("content", F.lit("")) == "", "no content").otherwise(F.col("reject")))
    head = N.front_matter(
        F.coalesce("title", "slug"), F.col("url"), created, F.array(F.lit("clippings"), F.lit("snowflake")), F.col("authors"),
        F.col("date"), F.col("description"))
    return rows.select(
        "slug", "url", "title", F.array_join("authors", ", ").alias("author"), T.word_count("content").alias("word_count"),
        T.char_count("content").alias("char_count"),
        N.output_path(F.lit("Snowflake"), T.sanitize_filename(F.coalesce(T.nullif_blank("title"), F.col("slug")))).alias("file_path"),
        N.article_note(head, F.col("content")).alias("note"), "reject")


def choose_payloads(pending: DataFrame, fetched: DataFrame, prefix: str = V.BLOG_PREFIX) -> DataFrame:
    """``(url, body)``: for each pending post the payload of its first data address that holds an article.

    ``fetched(data_url, body)``; the second address is looked at only for posts whose first one gave nothing.
    """
    def at(rank: int) -> Callable[[DataFrame], DataFrame]:
        def read(posts: DataFrame) -> DataFrame:
            address = F.get(U.json_endpoint_candidates("url", prefix), F.lit(rank))
            found = posts.select("url", "content_type", address.alias("data_url")).join(fetched, "data_url")
            return found.select("url", F.when(readable("body", "content_type"), F.col("body")).alias("content"))

        return read

    served = first_success(pending.select("url", "content_type"), "url", at(0), at(1))
    return served.filter(F.col("content").isNotNull()).select("url", F.col("content").alias("body"))


def read_payloads(pending: DataFrame, payloads: DataFrame, created: Column) -> DataFrame:
    """Pending rows with their article, note and ``reject`` reason.

    ``payloads(url, body)`` holds what was fetched. Each type is read by its own schema
    in one pass. A row without a payload is rejected, not lost.
    """
    found = payloads.join(pending.select("url", "content_type"), "url")
    articles = typed_payloads(found).drop("content_type")
    converted = pages_to_markdown(
        pages_to_markdown(articles, "article", "body_html", "content"), "article", "summary_html", "summary")
    gated = quality_gate(converted, html="body_html", text="content", min_html=V.MIN_HTML, min_text=V.MIN_ARTICLE)
    rows = pending.join(gated, "url", "left").withColumn(
        "reject", F.when(F.col("title").isNull() | (F.coalesce("content", F.lit("")) == ""), "no content").otherwise(F.col("reject")))
    labels = type_labels("content_type")
    head = N.front_matter(
        F.coalesce("title", "slug"), F.col("url"), created, labels["tags"], F.col("authors"), F.col("date"), F.col("description"))
    return rows.select(
        "slug", "url", "content_type", "title", F.array_join("authors", ", ").alias("author"),
        T.word_count("content").alias("word_count"), T.char_count("content").alias("char_count"),
        N.blog_path("title", "slug", "content_type").alias("file_path"),
        N.article_note(head, F.col("content"), F.col("summary")).alias("note"), "reject")


def record_run(ledger: DataFrame, read: DataFrame, run_ts: Column) -> DataFrame:
    """The ledger after a run: read rows downloaded, rejected rows failed."""
    error = F.struct(
        F.lit("no_content").alias("reason"), F.col("reject").alias("detail"), F.lit("").alias("html"))
    outcomes = read.withColumn("error", F.when(F.col("reject").isNotNull(), error))
    return apply_outcomes(ledger, outcomes, ["slug"], run_ts)
