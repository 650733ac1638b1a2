"""Series linking: downloaded posts whose titles are parts of one series."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gleaner.functions import notes as N
from gleaner.operators.sequences import series_nav


def link_series(posts: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes ``(id, content)`` of posts ``(id, title, status)`` with their series navigation.

    Notes outside a series do not appear; a second run gives the same text.
    """
    blocks = series_nav(posts.filter("status = 'downloaded'").select("id", "title"))
    return notes.join(blocks.select("id", "block"), "id").select(
        "id", N.with_series_nav("content", "block").alias("content"))
