"""Note rendering: front matter, chapter and index templates, navigation footers, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import values as V
from gleaner.functions import text as T
from gleaner.functions.text import as_col, nullif_blank


def _list_block(key: str, items: Column, before: str, after: str) -> Column:
    """``key:`` and one quoted line per item; null for a null or empty list."""
    lines = F.transform(items, lambda x: F.concat(F.lit(f'  - "{before}'), x, F.lit(f'{after}"')))
    return F.when(F.size(items) > 0, F.concat(F.lit(f"{key}:\n"), F.array_join(lines, "\n")))


def front_matter(
    title: Column, url: Column, created: Column, tags: Column,
    authors: Column | None = None, published: Column | None = None,
    description: Column | None = None,
) -> Column:
    """YAML head of a note; absent parts leave no line. ``created`` is the run's day."""
    none = F.lit(None).cast("string")
    authors = authors if authors is not None else F.lit(None).cast("array<string>")
    published = published.cast("string") if published is not None else none
    description = nullif_blank(description) if description is not None else none
    return F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit('title: "'), T.yaml_quote(title), F.lit('"')),
        F.concat(F.lit('source: "'), url, F.lit('"')),
        _list_block("author", authors, "[[", "]]"),
        F.concat(F.lit("published: "), nullif_blank(published)),
        F.concat(F.lit("created: "), created.cast("string")),
        F.concat(F.lit('description: "'), T.yaml_quote(description), F.lit('"')),
        _list_block("tags", tags, "", ""),
        F.lit("---"),
    )


def article_note(head: Column, content: Column, summary: Column | None = None) -> Column:
    """Head, optional summary section, content."""
    summary = nullif_blank(summary) if summary is not None else F.lit(None).cast("string")
    section = F.concat(F.lit("#### Summary\n\n"), summary)
    return F.concat_ws("\n", head, section, F.lit(""), content, F.lit(""))


def transcript_head(title: Column, url: Column, author: Column) -> Column:
    video = F.coalesce(nullif_blank(title), F.lit("YouTube Video"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("**Video:** ["), video, F.lit("]("), url, F.lit(")")),
        F.concat(F.lit("**Channel:** "), nullif_blank(author)),
        F.lit("\n## Transcript"),
    )


def book_head(folder: Column | str, tag: Column | str) -> Column:
    return F.concat(
        F.lit("---\ntags:\n  - book/novel\n  - "), as_col(tag), F.lit("\n---\n\n# "), as_col(folder)
    )


def chapter_note(folder: Column | str, tag: Column | str, num: Column | str, content: Column | str) -> Column:
    folder = as_col(folder)
    return F.concat(
        book_head(folder, tag),
        F.lit("\n\n**Novel:** "), folder,
        F.lit("\n\n**Chapter:** "), as_col(num).cast("string"),
        F.lit("\n\n---\n\n"), as_col(content), F.lit("\n"),
    )


def plain_chapter_note(title: Column | str, content: Column | str) -> Column:
    return F.concat(F.lit("# "), as_col(title), F.lit("\n\n"), as_col(content), F.lit("\n"))


def index_head(folder: Column | str, tag: Column | str) -> Column:
    return F.concat(book_head(folder, tag), F.lit("\n\n## Table of Contents\n"))


def converted_index_head(folder: Column | str, tag: Column | str) -> Column:
    return F.concat(book_head(folder, tag), F.lit("\n\n## Table of Contents\n---\n"))


def toc_line(folder: Column | str, num: Column | str) -> Column:
    num = as_col(num)
    return F.concat(
        F.lit("- [["), T.chapter_link(folder, num), F.lit("|Chapter "), num.cast("string"), F.lit("]]")
    )


def converted_toc_line(folder: Column | str, num: Column | str) -> Column:
    """Line of an index made for converted folders: anchor, then underscored link."""
    text = as_col(num).cast("string")
    link = F.format_string("%04d_-_%s", as_col(num).cast("long"), F.translate(as_col(folder), " ", "_"))
    return F.concat(
        F.lit("- [Chapter "), text, F.lit("](#chapter-"), text, F.lit(") -> [["), link, F.lit("]]")
    )


def nav_footer(folder: Column | str, prev_num: Column | str, next_num: Column | str) -> Column:
    """Previous, index and next links; the ends say so."""
    folder, before, after = as_col(folder), as_col(prev_num), as_col(next_num)

    def link(num: Column, left: str, right: str) -> Column:
        return F.concat(
            F.lit("[["), T.chapter_link(folder, num), F.lit("|" + left), num.cast("string"), F.lit(right + "]]")
        )

    back = F.when(before.isNull(), "*(first)*").otherwise(link(before, "← Ch ", ""))
    ahead = F.when(after.isNull(), "*(last)*").otherwise(link(after, "Ch ", " →"))
    index = F.concat(F.lit("[["), T.index_link(folder), F.lit("|Index]]"))
    return F.concat(
        F.lit(f"\n\n---\n\n{V.NAV_MARKER}\n"), F.concat_ws(" | ", back, index, ahead), F.lit("\n")
    )


def series_nav(prev_title: Column | str, next_title: Column | str) -> Column:
    def line(arrow: str, title: Column) -> Column:
        return F.concat(F.lit(f"- {arrow}: [["), T.sanitize_filename(title), F.lit("]]"))

    return F.concat_ws(
        "\n",
        F.lit("\n---\n\n**Series Navigation**\n"),
        line("← Previous", as_col(prev_title)),
        line("→ Next", as_col(next_title)),
        F.lit(""),
    )


def with_nav(content: Column | str, footer: Column | str) -> Column:
    """Replace an older footer, so that a second run changes nothing."""
    return F.concat(T.strip_nav_footer(content), as_col(footer))


def with_series_nav(content: Column | str, block: Column | str) -> Column:
    return F.concat(T.strip_series_nav(content), as_col(block))


def output_path(label: Column | str, name: Column | str, subfolder: Column | None = None) -> Column:
    """``label/subfolder/name.md``; a missing subfolder leaves no empty segment."""
    parts = [as_col(label)] + ([nullif_blank(subfolder)] if subfolder is not None else [])
    return F.concat(F.concat_ws("/", *parts, as_col(name)), F.lit(".md"))


def blog_path(title: Column | str, slug: Column | str, content_type: Column | str) -> Column:
    folder = F.when(as_col(content_type) == "glossary", "Databricks Glossary").otherwise("Databricks")
    return output_path(folder, T.sanitize_filename(F.coalesce(nullif_blank(title), as_col(slug))))


def bookmark_path(title: Column | str, family: Column | str) -> Column:
    folder = F.when(as_col(family) == "youtube", "YouTube").otherwise("Raindrop")
    name = F.coalesce(nullif_blank(title), F.lit("Untitled"))
    return output_path(folder, T.sanitize_filename(name, 200))


def doc_path(label: Column | str, slug: Column | str) -> Column:
    """Page path that mirrors the slug's hierarchy."""
    from gleaner.functions.urls import parent_path

    name = T.sanitize_segment(F.substring_index(as_col(slug), "/", -1))
    return output_path(label, name, parent_path(slug))
