"""Nested page trees in JSON to page rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import nullif_blank

#: Levels of a tree; JSON itself is read to a depth of 1,000 brackets only.
MAX_LEVELS = 1000

#: A node is parsed once, with its whole tree; below it only parts of that value are handed on.
_WALK = f"""
WITH RECURSIVE walk(key, ord, parent_path, kind, href, label, title, children) MAX RECURSION LEVEL {MAX_LEVELS} AS (
  SELECT key, cast(array() AS array<int>), '',
    try_variant_get(node, '$.type', 'string'), try_variant_get(node, '$.href', 'string'),
    try_variant_get(node, '$.label', 'string'), try_variant_get(node, '$.title', 'string'),
    try_variant_get(node, '$.children', 'array<variant>')
  FROM (SELECT key, try_parse_json(node) AS node FROM {{trees}})
  UNION ALL
  SELECT key, array_append(ord, pos),
    CASE WHEN kind = 'page' AND href <> '' THEN regexp_replace(ltrim('/', href), '^en/', '') ELSE parent_path END,
    try_variant_get(node, '$.type', 'string'), try_variant_get(node, '$.href', 'string'),
    try_variant_get(node, '$.label', 'string'), try_variant_get(node, '$.title', 'string'),
    try_variant_get(node, '$.children', 'array<variant>')
  FROM walk, LATERAL posexplode(children) AS child(pos, node)
  WHERE size(children) > 0
)
SELECT key, ord, parent_path, href, label, title FROM walk WHERE kind = 'page'
"""


def _lift_row_limit(spark: SparkSession) -> None:
    """Recursive queries of the session may return any number of rows (by default they fail after a million)."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")


def page_tree(trees: DataFrame, base_url: str) -> DataFrame:
    """``(key, ord, slug, url, title, parent_path)`` of all pages in ``trees(key, node)``.

    One recursive query opens the children of the level above, a narrow step without a shuffle. ``ord``
    holds the child positions from the root, so that sorting by it gives the order of a depth-first walk.
    A page's parent is its nearest ancestor that is a page. A null or broken node gives no row; children
    that are no list count as none.
    """
    spark = trees.sparkSession
    _lift_row_limit(spark)
    pages = spark.sql(_WALK, trees=trees.select("key", "node"))
    return pages.where(nullif_blank("href").isNotNull()).select(
        "key", "ord", F.regexp_replace(F.ltrim("href", F.lit("/")), "^en/", "").alias("slug"),
        F.concat(F.lit(base_url), "href").alias("url"),
        F.coalesce(nullif_blank("label"), nullif_blank("title"), F.lit("")).alias("title"), "parent_path")
