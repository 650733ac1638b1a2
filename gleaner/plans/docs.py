"""Documentation runs: entries of all sites, pages read by their site's rules, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import html as H
from gleaner.functions import notes as N
from gleaner.functions import text as T
from gleaner.operators.joins import discover_new, supplement
from gleaner.operators.markdown import PROFILES, html_blocks, render_blocks
from gleaner.profiles import doc_entries, with_rules


def discover_docs(entries: DataFrame, ledger: DataFrame) -> DataFrame:
    """Entries ``(site, url, ord)`` of all sites that the ledger does not know, as pending rows."""
    return discover_new(doc_entries(entries), ledger, ["site", "slug"], ["ord"])


def with_link_index(entries: DataFrame, links: DataFrame) -> DataFrame:
    """Sitemap entries, then those of a link index that the sitemap lacks."""
    return supplement(entries, links)


def read_docs(pages: DataFrame) -> DataFrame:
    """``pages(site, slug, html)`` with ``title``, ``content`` and ``reject``, all sites in one pass."""
    ruled = with_rules(pages)
    is_mdx = F.col("markdown").eqNullSafe("mdx")
    family = {n: p for n, p in PROFILES.items() if "docs" in n}
    blocks = html_blocks(F.when(~is_mdx, F.col("html")), family, "markdown")
    content = F.when(is_mdx, H.mdx_clean("html")).otherwise(render_blocks("_blocks", "docs"))
    read = ruled.withColumn("_blocks", blocks).withColumn("content", content)
    heading = F.when(is_mdx, F.coalesce(T.first_heading("content"), T.title_from_slug("slug"))).otherwise(
        H.title_by_order("html", "titles"))
    length = F.coalesce(F.length("content"), F.lit(0))
    reject = F.when(F.col("label").isNull(), F.lit("unknown site")).when(
        length < F.col("min_text"), F.format_string("Content too short (%d chars) for %s", length, "slug"))
    return read.select(
        *[c for c in pages.columns if c != "html"],
        F.coalesce(heading, F.substring_index("slug", "/", -1)).alias("title"), "content", reject.alias("reject"))


def doc_notes(read: DataFrame, entries: DataFrame, created: Column) -> DataFrame:
    """``(site, slug, path, content)`` of the pages that passed, with the entries' paths and tags."""
    passed = T.one_if(F.struct("content", "reject"), lambda r: r["reject"].isNull())
    rows = read.select("site", "slug", "title", passed.alias("r")).select("site", "slug", "title", "r.content").join(
        entries.select("site", "slug", "url", "path", "tags"), ["site", "slug"])
    head = N.front_matter(F.coalesce("title", "slug"), F.col("url"), created, F.col("tags"))
    return rows.select("site", "slug", "path", N.article_note(head, F.col("content")).alias("content"))
