"""Link lists in Markdown and HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.html import anchors
from gleaner.functions.text import chapter_no, nullif_blank
from gleaner.operators.sequences import dedup_first


def md_links(texts: DataFrame, prefix: str) -> DataFrame:
    """``(key, ord, title, url)``: ``[title](https://….md)`` links below a prefix, in text order."""
    pattern = r"\[([^\]\n]+)\]\((https://[^)\n]+\.md)\)"
    links = F.arrays_zip(
        F.regexp_extract_all("body", F.lit(pattern), F.lit(1)).alias("title"),
        F.regexp_extract_all("body", F.lit(pattern), F.lit(2)).alias("url"),
    )
    rows = texts.select("key", F.posexplode(links).alias("ord", "link"))
    return rows.select("key", "ord", "link.title", "link.url").filter(F.col("url").startswith(prefix))


def chapter_links(
    pages: DataFrame, require: str = "/novel/", exclude: str | None = "tab=", text_only: bool = False
) -> DataFrame:
    """``(key, ord, num, url, title)`` of chapter anchors in ``pages(key, html)``.

    ``require`` is a pattern of the target. The number comes from the link text, else
    (unless ``text_only``) from the target; links with neither drop. The title
    attribute beats the text.
    """
    rows = pages.select("key", F.posexplode(anchors(F.col("html"))).alias("ord", "a"))
    a = F.col("a")
    kept = rows.filter(a["href"].rlike(require) & (a["text"] != ""))
    if exclude:
        kept = kept.filter(~a["href"].contains(exclude))
    return kept.select(
        "key", "ord", chapter_no(a["text"], F.lit("") if text_only else a["href"]).alias("num"), a["href"].alias("url"),
        F.coalesce(nullif_blank(a["title"]), a["text"]).alias("title"),
    ).filter(F.col("num").isNotNull())


# --- fixed values: how each site's chapter list links its chapters ---
SITE_LINKS = {
    "lightnovelstranslations.com": {"require": "/novel/", "exclude": "tab="},
    "novelbin.com": {"require": "chapter", "exclude": None, "text_only": True},
    "webnovel.com": {"require": r"/book/\d+/\d+", "exclude": None, "text_only": True},
}


def site_chapters(pages: DataFrame, site: str) -> DataFrame:
    """Chapters of a site's list pages, first link of each number."""
    return dedup_first(chapter_links(pages, **SITE_LINKS[site]), ["key", "num"], ["ord"])


def highest_chapter(pages: DataFrame) -> DataFrame:
    """``(key, max_num)``: highest ``chapter-n`` target among a page's links."""
    numbers = F.regexp_extract_all("html", F.lit(r"href\s*=\s*[\"']?[^\"'\s>]*?chapter-(\d+)"), F.lit(1))
    highest = F.array_max(F.transform(numbers, lambda n: n.try_cast("long")))
    return pages.select("key", highest.alias("max_num")).filter(F.col("max_num") > 0)


def chapter_sequence(heads: DataFrame, base_url: str) -> DataFrame:
    """``(key, num, url, title)``: one row per chapter from 1 to ``heads.max_num``.

    Numbers come in runs of a thousand, so that no row holds all of a long sequence.
    """
    top = F.col("max_num").cast("long")
    runs = heads.filter(F.col("max_num") > 0).select("key", "slug", top.alias("top"), F.explode(F.sequence(
        F.lit(0).cast("long"), F.expr("(max_num - 1) div 1000"))).alias("run"))
    rows = runs.select("key", "slug", F.explode(F.sequence(
        F.col("run") * 1000 + 1, F.least(F.col("run") * 1000 + 1000, "top"))).alias("num"))
    return rows.select(
        "key", "num",
        F.format_string(f"{base_url}/%s/chapter-%d.html", "slug", "num").alias("url"),
        F.format_string("Chapter %d", "num").alias("title"),
    )
