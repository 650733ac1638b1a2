"""JSON payloads to tables: articles, glossary pages, chapters, bookmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions.text import nullif_blank, strip

_NAMED = "array<struct<entity:struct<name:string>>>"
_META = "array<struct<key:string,value:string>>"
_HTML = "struct<processed:string>"
_ARTICLE = (
    f"result struct<data:struct<drupal:struct<article:struct<title:string,fieldAuthors:{_NAMED},"
    f"entityCreatedRaw:string,fieldDate:string,entityMetatags:{_META},fieldAiSummary:{_HTML},"
    f"fieldCategories:{_NAMED},fieldTags:{_NAMED},body:{_HTML}>>>>"
)
_GLOSSARY = (
    f"result struct<data:struct<drupal:struct<glossaryPage:struct<title:string,entityMetatags:{_META},"
    f"fieldComponents:array<struct<entity:struct<fieldBody:{_HTML}>>>>>>>"
)


def _present(items: Column) -> Column:
    """Entries that are neither null nor blank, in order."""
    kept = F.filter(items, lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(kept, F.array().cast("array<string>"))


def _entity_names(entries: Column) -> Column:
    return _present(F.transform(entries, lambda e: e["entity"]["name"]))


def _description(metatags: Column) -> Column:
    found = F.filter(metatags, lambda m: m["key"] == "description")
    return F.coalesce(F.get(found, F.lit(0))["value"], F.lit(""))


def _article(body: Column) -> Column:
    """Fields of an article payload; null without title or body."""

    def fields(a: Column) -> Column:
        stamp = F.coalesce(nullif_blank(a["entityCreatedRaw"]), a["fieldDate"])
        return F.when((a["title"] != "") & (a["body"]["processed"] != ""), F.struct(
            a["title"].alias("title"),
            _entity_names(a["fieldAuthors"]).alias("authors"),
            T.iso_date_prefix(stamp).alias("date"),
            _description(a["entityMetatags"]).alias("description"),
            F.coalesce(a["fieldAiSummary"]["processed"], F.lit("")).alias("summary_html"),
            T.append_absent(_entity_names(a["fieldCategories"]), _entity_names(a["fieldTags"])).alias("categories"),
            a["body"]["processed"].alias("body_html"),
        ))

    return T.let(F.from_json(body, _ARTICLE)["result"]["data"]["drupal"]["article"], fields)


def _glossary(body: Column) -> Column:
    """Fields of a glossary payload, the bodies of all components joined by line."""

    def fields(p: Column) -> Column:
        bodies = _present(F.transform(p["fieldComponents"], lambda c: c["entity"]["fieldBody"]["processed"]))
        none = F.array().cast("array<string>")
        return T.let(F.array_join(bodies, "\n"), lambda html: F.when((p["title"] != "") & (html != ""), F.struct(
            p["title"].alias("title"), none.alias("authors"), F.lit(None).cast("date").alias("date"),
            _description(p["entityMetatags"]).alias("description"), F.lit("").alias("summary_html"),
            none.alias("categories"), html.alias("body_html"),
        )))

    return T.let(F.from_json(body, _GLOSSARY)["result"]["data"]["drupal"]["glossaryPage"], fields)


def _rows(docs: DataFrame, fields: Column, *keep: str) -> DataFrame:
    found = T.one_if(fields, lambda x: x.isNotNull())
    return docs.select(*keep, found.alias("f")).select(*keep, "f.*")


def article_json(docs: DataFrame) -> DataFrame:
    """``(url, title, authors, date, description, summary_html, categories, body_html)``.

    A payload without title or body is no article and gives no row.
    """
    return _rows(docs, _article(F.col("body")), "url")


def glossary_json(docs: DataFrame) -> DataFrame:
    """Glossary payloads in the same columns as articles."""
    return _rows(docs, _glossary(F.col("body")), "url")


def typed_payloads(docs: DataFrame) -> DataFrame:
    """Payloads ``(url, content_type, body)``, each read by its type, in one pass."""
    body, glossary = F.col("body"), F.col("content_type") == "glossary"
    return _rows(docs, F.when(glossary, _glossary(body)).otherwise(_article(body)), "url", "content_type")


def readable(body: Column | str, content_type: Column | str) -> Column:
    """Whether a payload holds an article of its type."""
    body, glossary = T.as_col(body), T.as_col(content_type) == "glossary"
    return F.when(glossary, _glossary(body).isNotNull()).otherwise(_article(body).isNotNull())


def volume_chapters(docs: DataFrame) -> DataFrame:
    """``(key, id, num, title)`` of every catalogued chapter that has an id and an index."""
    schema = "data struct<volumeItems:array<struct<chapterItems:array<struct<id:string,index:bigint,name:string>>>>>"
    volumes = F.from_json("body", schema)["data"]["volumeItems"]
    chapters = F.flatten(F.transform(volumes, lambda v: F.coalesce(v["chapterItems"], F.array().cast(
        "array<struct<id:string,index:bigint,name:string>>"))))
    rows = docs.select("key", F.explode(chapters).alias("c"))
    c = F.col("c")
    return rows.filter(nullif_blank(c["id"]).isNotNull() & (F.coalesce(c["index"], F.lit(0)) != 0)).select(
        "key", c["id"].alias("id"), c["index"].alias("num"),
        F.coalesce(c["name"], F.concat(F.lit("Chapter "), c["index"].cast("string"))).alias("title"),
    )


def chapter_body(body: Column | str) -> Column:
    """Non-blank paragraphs of a chapter payload, trimmed, joined by a blank line."""
    schema = "data struct<chapterInfo:struct<chapterName:string,contents:array<struct<content:string>>>>"
    contents = F.from_json(T.as_col(body), schema)["data"]["chapterInfo"]["contents"]
    return F.array_join(_present(F.transform(contents, lambda c: strip(c["content"]))), "\n\n")


def bookmark_items(pages: DataFrame) -> DataFrame:
    """Bookmarks of all result pages; an entry needs an id and a link."""
    schema = (
        "items array<struct<_id:bigint,link:string,title:string,domain:string,excerpt:string,note:string,"
        "tags:array<string>,type:string,cover:string,created:string,lastUpdate:string>>"
    )
    rows = pages.select(F.explode(F.from_json("body", schema)["items"]).alias("i"))
    i = F.col("i")
    return rows.filter((F.coalesce(i["_id"], F.lit(0)) != 0) & nullif_blank(i["link"]).isNotNull()).select(
        i["_id"].alias("raindrop_id"), i["link"].alias("url"), i["title"].alias("title"),
        i["domain"].alias("domain"), i["excerpt"].alias("excerpt"), i["note"].alias("note"),
        F.coalesce(i["tags"], F.array().cast("array<string>")).alias("tags"),
        i["type"].alias("bookmark_type"), i["cover"].alias("cover_url"),
        F.try_to_timestamp(i["created"]).alias("raindrop_created"),
        F.try_to_timestamp(i["lastUpdate"]).alias("raindrop_updated"),
    )
