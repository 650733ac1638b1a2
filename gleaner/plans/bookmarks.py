"""Bookmark runs: routing, outcomes, notes with merged tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import html as H
from gleaner.functions import notes as N
from gleaner.functions import text as T
from gleaner.functions import urls as U
from gleaner.operators.joins import discover_new, join_per_parent, resolve_short_links, route_items
from gleaner.operators.ledger import apply_outcomes, classify_outcome
from gleaner.operators.markdown import pages_to_markdown
from gleaner.session import written


def discover_bookmarks(
    items: DataFrame, ledger: DataFrame, feed_ledger: DataFrame, route: bool = True
) -> tuple[DataFrame, DataFrame]:
    """``(new bookmarks, rows for the feed ledger)``; only new bookmarks are routed."""
    fresh = discover_new(items, ledger, ["raindrop_id"], ["url"]).drop("status")
    return route_items(fresh, feed_ledger, route)


def page_articles(fetches: DataFrame) -> DataFrame:
    """``(url, title, author, date, description, content, word_count, char_count, error)`` of fetched pages.

    ``fetches(url, status_code, exc, body)``. ``error`` says why a page gave no article, and is null where it did.
    """
    def fields(tags: Column) -> Column:
        return F.struct(
            F.coalesce(H.meta(tags, "og:title"), H.tag_text("body", "title")).alias("title"),
            F.coalesce(H.meta(tags, "author"), H.meta(tags, "article:author")).alias("author"),
            T.iso_date_prefix(F.coalesce(H.meta(tags, "article:published_time"), H.meta(tags, "date"))).alias("date"),
            F.coalesce(H.meta(tags, "og:description"), H.meta(tags, "description")).alias("description"))

    read = pages_to_markdown(fetches.withColumn("page", T.let(H.metas("body"), fields)), "article_page", "body")
    return classify_outcome(read).select(
        "url", "page.*", "content", T.word_count("content").alias("word_count"), T.char_count("content").alias("char_count"), "error")


def run_bookmarks(
    ledger: DataFrame, bookmarks: DataFrame, redirects: DataFrame, fetches: DataFrame, created: Column, run_ts: Column
) -> dict[str, DataFrame]:
    """``notes`` of the bookmarks whose page was read, and the ``ledger`` after the run.

    ``bookmarks(raindrop_id, url, title, excerpt, tags)`` are pending rows of the ledger. A page is read once,
    however many bookmarks lead to it; a bookmark whose page was not fetched fails.
    """
    asked = resolve_short_links(bookmarks, redirects)
    wanted = asked.select(F.col("resolved").alias("url")).distinct()
    articles = written(page_articles(wanted.join(fetches, "url", "left")), "articles")
    page = articles.select(F.col("url").alias("resolved"), F.col("title").alias("page_title"), "author", "word_count", "char_count", "error")
    read = join_per_parent(asked.select("raindrop_id", "url", "title", "resolved"), page, ["resolved"], ["raindrop_id"], "inner")
    title = F.coalesce(T.nullif_blank("page_title"), T.nullif_blank("title"))
    outcomes = read.select(
        "raindrop_id", title.alias("title"), "author", "word_count", "char_count",
        N.bookmark_path(title, U.url_family("url")).alias("file_path"), "error")
    return {"notes": bookmark_notes(bookmarks, articles.filter("error IS NULL"), redirects, created),
            "ledger": apply_outcomes(ledger, outcomes, ["raindrop_id"], run_ts)}


def bookmark_notes(bookmarks: DataFrame, articles: DataFrame, redirects: DataFrame, created: Column) -> DataFrame:
    """``(raindrop_id, path, content)``: notes of bookmarks whose page was read.

    ``articles(url, title, author, date, description, content)`` is keyed by the final
    URL; short links are resolved first. The page's own fields beat the bookmark's.
    Pages are wide, so they are not repeated to spread a URL that many bookmarks share:
    the inner join is one that adaptive execution splits when a key is skewed.
    """
    final = resolve_short_links(bookmarks, redirects)
    page = articles.select(
        F.col("url").alias("resolved"), *[F.col(c).alias(f"page_{c}") for c in ("title", "author", "date", "description", "content")])
    rows = final.join(page, "resolved").withColumns({
        "family": U.url_family("url"),
        "title": F.coalesce(T.nullif_blank("page_title"), T.nullif_blank("title"), F.lit("Untitled")),
    })
    base = F.array(F.lit("clippings"), F.lit("raindrop"))
    base = F.when(F.col("family") == "youtube", F.array_append(base, "youtube")).otherwise(base)
    head = N.front_matter(
        F.col("title"), F.col("url"), created, T.merge_tags(base, F.col("tags")),
        F.when(T.nullif_blank("page_author").isNotNull(), F.array("page_author")), F.col("page_date"),
        F.coalesce(T.nullif_blank("page_description"), F.col("excerpt")))
    return rows.select(
        "raindrop_id", N.bookmark_path("title", "family").alias("path"),
        N.article_note(head, F.col("page_content")).alias("content"))
