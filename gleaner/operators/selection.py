"""Selections, gates and column updates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import values as V


def select_items(
    ledger: DataFrame, status: str | None = None, source: str | None = None,
    username: str | None = None, content_type: str | None = None, slug: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Ledger rows by id; an empty argument does not filter, no limit gives all rows."""
    wanted = {"status": status, "source": source, "username": username,
              "content_type": content_type, "slug": slug}
    for column, value in wanted.items():
        if value:
            ledger = ledger.filter(F.col(column) == value)
    ordered = ledger.orderBy("id")
    return ordered.limit(limit) if limit else ordered


def get_item(
    items: DataFrame, id: int | None = None, name: str | None = None,
    slug: str | None = None, source: str | None = None,
) -> DataFrame:
    """One item by id, else by name, else by slug and source; no argument gives none."""
    if id:
        found = items.filter(F.col("id") == id)
    elif name:
        found = items.filter(F.col("name") == name)
    elif slug and source:
        found = items.filter((F.col("slug") == slug) & (F.col("source") == source))
    else:
        found = items.filter(F.lit(False))
    return found.limit(1)


def unmoved(ledger: DataFrame) -> DataFrame:
    """Downloaded rows that have a file and are not published."""
    return ledger.filter(
        (F.col("status") == V.DOWNLOADED) & ~F.col("in_obsidian") & F.col("file_path").isNotNull()
    )


def failed_report(ledger: DataFrame, id: int | None = None, limit: int | None = None) -> DataFrame:
    """Failed rows by id, with reason, detail and the first characters of the page."""
    failed = ledger.filter(F.col("status") == V.FAILED)
    if id:
        failed = failed.filter(F.col("id") == id)
    report = failed.select(
        "id", F.coalesce("title", F.lit("(untitled)")).alias("title"), "url",
        F.coalesce("error_reason", F.lit("unknown")).alias("reason"),
        F.col("error_detail").alias("detail"),
        F.left("error_html", F.lit(V.PREVIEW_CHARS)).alias("preview"),
    ).orderBy("id")
    return report.limit(limit) if limit else report


def drop_boilerplate(
    paragraphs: Column | str, phrases: list[str], min_len: int = V.MIN_PARAGRAPH, head: int | None = None
) -> Column:
    """Paragraphs above the length that hold none of the phrases (in their head, if given)."""
    source = F.col(paragraphs) if isinstance(paragraphs, str) else paragraphs

    listed = F.lit("(?s)" + "|".join(re.escape(s) for s in phrases))

    def keep(p: Column) -> Column:
        seen = F.left(F.lower(p), F.lit(head)) if head else F.lower(p)
        return (F.length(p) > min_len) & ~F.rlike(seen, listed)

    return F.filter(source, keep)


def site_boilerplate(paragraphs: Column | str, site: Column) -> Column:
    """``drop_boilerplate`` by the rules of each row's site; unknown sites keep all."""
    source = F.col(paragraphs) if isinstance(paragraphs, str) else paragraphs
    result = source
    for name, phrases in V.BOILERPLATE.items():
        kept = drop_boilerplate(source, phrases, head=V.BOILERPLATE_HEAD.get(name))
        result = F.when(site == name, kept).otherwise(result)
    return result


def quality_gate(
    frame: DataFrame, html: str | None = None, text: str = "content",
    min_html: int = V.MIN_HTML, min_text: int = V.MIN_ARTICLE,
) -> DataFrame:
    """Add ``reject``: null for a row that passes, else why not. Rejected rows stay."""
    length = F.coalesce(F.length(text), F.lit(0))
    short_text = F.when(
        length < min_text,
        F.concat(F.lit("text has "), length.cast("string"), F.lit(f" chars (min {min_text})")),
    )
    if html is None:
        return frame.withColumn("reject", short_text)
    size = F.coalesce(F.length(html), F.lit(0))
    short_html = F.when(
        size < min_html,
        F.concat(F.lit("html has "), size.cast("string"), F.lit(f" chars (min {min_html})")),
    )
    return frame.withColumn("reject", F.coalesce(short_html, short_text))


def chapter_range(chapters: DataFrame, start: int, end: int) -> DataFrame:
    return chapters.filter(F.col("num").between(start, end))


def set_columns(
    frame: DataFrame, where: Column, allowed: list[str], **values: Column | str | int | bool | None
) -> DataFrame:
    """Set columns of the rows that match; names outside the allow-list do nothing."""
    updates = {
        name: F.when(where, value if isinstance(value, Column) else F.lit(value)).otherwise(F.col(name))
        for name, value in values.items() if name in allowed
    }
    return frame.withColumns(updates) if updates else frame


def type_labels(content_type: Column | str) -> Column:
    """``struct<folder, tags>`` that a row's type decides."""
    kind = F.col(content_type) if isinstance(content_type, str) else content_type
    base = F.array(F.lit("clippings"), F.lit("databricks"))
    glossary = kind == "glossary"
    return F.struct(
        F.when(glossary, "Databricks Glossary").otherwise("Databricks").alias("folder"),
        F.when(glossary, F.array_append(base, "glossary")).otherwise(base).alias("tags"),
    )
