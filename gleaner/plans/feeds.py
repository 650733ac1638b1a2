"""Feed runs: items to pending rows, posts read from the first source that has them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import values as V
from gleaner.functions import notes as N
from gleaner.functions import text as T
from gleaner.functions import urls as U
from gleaner.operators.documents import paragraphs_markdown
from gleaner.operators.joins import discover_new, first_success
from gleaner.operators.markdown import pages_to_markdown
from gleaner.sources.feeds import rss_items


def discover_feed_posts(feeds: DataFrame, ledger: DataFrame) -> DataFrame:
    """Items of all feeds whose slug the ledger does not know; a slug's first feed item counts."""
    return discover_new(rss_items(feeds), ledger, ["slug"], ["username", "ord"])


def _converted(pages: DataFrame, html: str, profile: str) -> DataFrame:
    """``(slug, content)`` where page and text are long enough, else null content."""
    content = pages_to_markdown(pages, profile, html)
    usable = (F.length(html) >= V.MIN_HTML) & (F.length("content") >= V.MIN_ARTICLE)
    return content.select("slug", F.when(usable, F.col("content")).alias("content"))


def read_posts(posts: DataFrame, paragraphs: DataFrame, pages: DataFrame) -> DataFrame:
    """``posts(slug, url, content_html)`` with ``content`` and ``origin``: stored text, paragraph list, page.

    ``paragraphs(post_id, body)`` and ``pages(url, html)`` hold what was fetched; a
    page counts only with an article element. Paragraph lists and pages are converted for posts without earlier content only.
    """
    def stored(open_posts: DataFrame) -> DataFrame:
        return _converted(open_posts.filter("content_html IS NOT NULL").select("slug", "content_html"), "content_html", "article")

    def listed(open_posts: DataFrame) -> DataFrame:
        return open_posts.select("slug", U.post_id("url").alias("post_id")).join(paragraphs, "post_id").select(
            "slug", paragraphs_markdown("body").alias("content"))

    def fetched(open_posts: DataFrame) -> DataFrame:
        found = open_posts.select("slug", "url").join(pages, "url")
        return _converted(found.filter(F.col("html").rlike(r"(?i)<article\b")), "html", "article_page")

    return first_success(posts, "slug", stored, listed, fetched)


def post_notes(posts: DataFrame, created: Column) -> DataFrame:
    """``(slug, path, content)`` of the posts that have content."""
    head = N.front_matter(
        F.coalesce(T.nullif_blank("title"), F.col("slug")), F.col("url"), created,
        F.array(F.lit("clippings"), F.lit("medium")),
        F.when(T.nullif_blank("author").isNotNull(), F.array("author")), F.col("publish_date"), F.col("description"))
    name = T.sanitize_filename(F.coalesce(T.nullif_blank("title"), F.col("slug")))
    return posts.filter(F.col("content").isNotNull()).select(
        "slug", N.output_path(F.lit("Medium"), name).alias("path"), N.article_note(head, F.col("content")).alias("content"))
