"""RSS feeds ``(username, body)`` to one row per item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions.html import description_text
from gleaner.functions.urls import slug_last_segment

_FEED = (
    "channel struct<item: array<struct<title:string, link:string, `dc:creator`:string, description:string, "
    "pubDate:string, `atom:updated`:string, updated:string, category:array<string>, `content:encoded`:string>>>"
)


def rss_items(feeds: DataFrame) -> DataFrame:
    """Items with a link and a slug; dates parsed, description as plain text of 300 characters."""
    items = F.from_xml("body", _FEED)["channel"]["item"]
    rows = feeds.select("username", F.posexplode(items).alias("ord", "item"))
    item = F.col("item")
    names = F.filter(F.transform(item["category"], T.strip), lambda c: c != "")
    return rows.select(
        "username", "ord",
        slug_last_segment(T.strip(item["link"])).alias("slug"),
        T.strip(item["link"]).alias("url"),
        T.strip(item["title"]).alias("title"),
        T.strip(item["dc:creator"]).alias("author"),
        description_text(item["description"]).alias("description"),
        T.rfc2822_date(item["pubDate"]).alias("publish_date"),
        T.rfc2822_date(F.coalesce(item["atom:updated"], item["updated"])).alias("updated_date"),
        names.alias("categories"),
        item["content:encoded"].alias("content_html"),
    ).filter(F.col("slug").isNotNull())
