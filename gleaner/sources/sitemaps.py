"""Sitemap documents ``(url, body)`` to page entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import strip
from gleaner.functions.urls import match_any_path
from gleaner.session import checkpoint_dir


def _locs(body: Column, element: str) -> Column:
    """Trimmed ``<element><loc>`` values of one document (empty for malformed XML)."""
    parsed = F.from_xml(body, f"{element} array<struct<loc:string>>")
    locs = F.transform(parsed[element], lambda e: strip(e["loc"]))
    return F.filter(locs, lambda loc: loc.isNotNull() & (loc != ""))


def sitemap_locs(docs: DataFrame) -> DataFrame:
    """``(parent, ord, loc)``: children of index documents, in document order."""
    return docs.select(
        F.col("url").alias("parent"), F.posexplode(_locs(F.col("body"), "sitemap")).alias("ord", "loc")
    )


def sitemap_urls(docs: DataFrame) -> DataFrame:
    """``(sitemap, ord, url)``: page entries of urlset documents, in document order."""
    return docs.select(
        F.col("url").alias("sitemap"), F.posexplode(_locs(F.col("body"), "url")).alias("ord", "url")
    )


def expand_sitemaps(
    docs: DataFrame, roots: DataFrame, keywords: list[str] | None = None, fallback: bool = False,
) -> DataFrame:
    """Page entries ``(sitemap, path, ord, url)`` of every sitemap that is reachable from ``roots(url)``.

    ``path`` holds the positions that lead to the sitemap: the root's (its ``ord`` if there is one), then the
    child's in each index. Entries by ``path`` and ``ord`` come in the order in which a walk meets them; a sitemap
    that several indexes name is met by its first path among the shortest ones.

    Index children must contain a keyword; with ``fallback`` a root without such a child keeps all its children.
    The walk is one join per level on narrow edges; each level is checkpointed, so lineage stays short and lost
    executors cost one level. Cycles end because a sitemap is visited once.
    """
    checkpoint_dir(docs.sparkSession)
    children = F.transform(_locs(F.col("body"), "sitemap"), lambda loc, i: F.struct(i.alias("at"), loc.alias("url")))
    chosen = F.filter(children, lambda c: match_any_path(c["url"], keywords or []))
    edges = docs.select("url", children.alias("all"), chosen.alias("chosen")).filter(
        F.size("all") > 0
    ).checkpoint()
    at_root = F.when((F.size("chosen") == 0) & F.lit(fallback), F.col("all")).otherwise(F.col("chosen"))

    position = F.col("ord").cast("int") if "ord" in roots.columns else F.lit(0)
    frontier = roots.groupBy("url").agg(F.array(F.min(position)).alias("path")).checkpoint()
    visited = frontier
    step = at_root
    while True:
        found = edges.join(frontier, "url").select("path", F.explode(step).alias("child")).groupBy(F.col("child.url").alias("url")).agg(
            F.min(F.array_append("path", F.col("child.at"))).alias("path"))
        frontier = found.join(visited, "url", "left_anti").checkpoint()
        if frontier.isEmpty():
            # only addresses and lists of entries meet the visited ones, not the bodies
            return sitemap_urls(docs).join(visited.withColumnRenamed("url", "sitemap"), "sitemap").select("sitemap", "path", "ord", "url")
        visited, step = visited.union(frontier), F.col("chosen")
