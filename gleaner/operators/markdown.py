"""HTML documents to Markdown, as a table job.

An Arrow UDF turns each HTML text into an array of blocks (other columns stay in the
JVM, nothing shuffles); results leave it in slices, as those of a whole batch would wait in memory. Rendering, table padding, callouts and blank lines are Column
expressions on that array.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import values as V
from gleaner.functions import html as H
from gleaner.functions import text as T
from gleaner.operators import html_blocks as helper
from gleaner.operators.html_blocks import Blocks, Profile
from gleaner.operators.selection import quality_gate

# The helper travels with the UDF, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(helper)

# --- fixed values: tags and classes that each profile leaves out ---
ARTICLE = Profile(
    skip_tags=frozenset("script style nav footer header iframe noscript svg".split()),
    skip_classes=frozenset("share social sidebar related comment newsletter cta navigation".split()),
)
STRICT = Profile(
    skip_tags=frozenset(
        "script style nav footer header iframe noscript svg aside form button input".split()),
    skip_classes=frozenset(
        "share social sidebar related comment newsletter cta navigation subscribe promo banner "
        "popup modal cookie ad advertisement".split()),
    removed_tags=frozenset("script style nav footer header iframe noscript aside".split()),
    roots=(
        ("tag", "article"), ("class", "article-content"), ("class", "article-body"),
        ("class", "post-content"), ("class", "blog-content"), ("class", "entry-content"),
        ("class", "content-body"), ("class", "blog-body"), ("class", "rich-text"),
        ("role", "main"), ("tag", "main"),
    ),
    root_min_text=V.MIN_VISIBLE,
    inline_data_images=False,
)
DOCS = Profile(
    skip_tags=frozenset("script style nav footer iframe noscript svg".split()),
    skip_classes=frozenset(
        "share social sidebar related comment newsletter cta breadcrumb breadcrumbs pagination "
        "site-navigation".split()),
    removed_tags=frozenset("nav footer aside script style noscript svg".split()),
    removed_classes=frozenset(
        "sidebar toc table-of-contents breadcrumb breadcrumbs pagination site-navigation".split()),
    nested_lists=True, definition_lists=True, code_prefixes=("language-", "lang-"),
)
PAGE_ROOTS = (("tag", "article"), ("tag", "main"), ("div", ("post", "article", "content", "entry")), ("role", "main"))
BODY_REMOVED = frozenset("nav footer header aside script style".split())
PROFILES = {
    "article": ARTICLE,
    "article_page": replace(ARTICLE, roots=PAGE_ROOTS, body_removed_tags=BODY_REMOVED),
    "strict": STRICT,
    "docs": DOCS,
    "docs_page": replace(DOCS, body_removed_tags=BODY_REMOVED, roots=(
        ("tag", "article"), ("tag", "main"), ("div", ("content",)), ("role", "main"))),
    "book_docs": replace(DOCS, body_removed_tags=BODY_REMOVED, roots=(
        ("tag", "article"), ("tag", "main"), ("div", ("page-body", "content", "markdown")), ("role", "main"))),
    "theme_docs": replace(
        DOCS, body_removed_tags=BODY_REMOVED,
        roots=(("tag", "article"), ("tag", "main"), ("any", ("docmaincontainer", "markdown"))),
        removed_class_parts=(
            "theme-doc-toc", "pagination-nav", "breadcrumbs", "theme-last-updated", "docusaurus-mt-lg", "col--3")),
    "cloud_docs": replace(
        DOCS,
        roots=(("id", "main-col-body"), ("id", "main-content"), ("id", "main-column"),
               ("tag", "main"), ("tag", "article")),
        removed_ids=frozenset(
            "guide-toc breadcrumbs page-toc-src left-column right-column doc-history-btn "
            "feedback-section quick-feedback".split()),
        removed_classes=DOCS.removed_classes | frozenset(
            "page-toc-container prev-next doc-history awsdocs-filter-selector "
            "awsdocs-language-banner".split())),
}

_BLOCKS = "array<struct<kind:string,level:int,text:string,extra:string,rows:array<array<string>>>>"
_ARROW_FIELDS = {
    "kind": pa.string(), "level": pa.int32(), "text": pa.string(), "extra": pa.string(),
    "rows": pa.list_(pa.list_(pa.string())),
}


def profile_of(name: str, class_match: str | None = None) -> Profile:
    """A named profile; ``substring`` also skips classes that only contain a listed word."""
    profile = PROFILES[name]
    return replace(profile, class_match=class_match) if class_match else profile


def html_blocks(html: Column | str, profile: Profile | dict[str, Profile], name: Column | str | None = None) -> Column:
    """Array of blocks of an HTML text, by one profile or by the one that ``name`` picks for the row."""
    choices = profile if isinstance(profile, dict) else {"": profile}

    def blocks_of(texts: pa.Array, names: pa.Array) -> pa.Array:
        blocks, ends = Blocks(), [0]
        for text, choice in zip(texts.to_pylist(), names.to_pylist()):
            if text is not None and choice in choices:
                blocks.read(text, choices[choice])
            ends.append(len(blocks))
        columns = [pa.array(c, type=t) for c, t in zip(blocks.columns, _ARROW_FIELDS.values())]
        values = pa.StructArray.from_arrays(columns, names=list(_ARROW_FIELDS))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=texts.is_null())

    @F.arrow_udf(_BLOCKS)
    def read(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in helper.slices(*batch):
                yield blocks_of(*part)

    return read(html, F.lit("") if name is None else name)


def element_paragraphs(html: Column | str, selectors: dict[str, list[str]], name: Column | str) -> Column:
    """Array, by the selectors that ``name`` picks, of the paragraph texts of each one's first element."""

    def paragraphs_of(texts: pa.Array, names: pa.Array) -> pa.Array:
        found = [
            helper.element_paragraphs(text, selectors[choice]) if text is not None and choice in selectors else None
            for text, choice in zip(texts.to_pylist(), names.to_pylist())]
        return pa.array(found, pa.list_(pa.list_(pa.string())))

    @F.arrow_udf("array<array<string>>")
    def read(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in helper.slices(*batch):
                yield paragraphs_of(*part)

    return read(html, name)


def _lines(block: Column, name: str) -> Column:
    """Markdown lines of one block."""
    strict, docs = name == "strict", name.endswith("docs") or name.startswith("docs")
    kind, text, extra = block["kind"], block["text"], block["extra"]
    gap, none = F.array(F.lit("")), F.array().cast("array<string>")

    def spaced(*lines: Column) -> Column:
        return F.concat(gap, *lines, gap)

    cells = F.transform(
        block["rows"],
        lambda row: F.transform(row, lambda c: F.replace(
            F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" " if docs else "\n"))),
    )
    quote = H.quote_lines(text)
    if docs:
        callout = H.callout_type(extra, text)
        head = F.array(F.concat(F.lit("> [!"), callout, F.lit("]")))
        quote = F.when(callout.isNotNull(), F.concat(head, H.quote_lines(H.callout_body(text)))).otherwise(quote)
    paragraph = F.concat(gap, F.array(text))
    image = F.concat(F.lit("!["), text, F.lit("]("), extra, F.lit(")"))
    return (
        F.when(kind == "line", F.array(text))
        .when(kind == "heading", F.when(text != "", spaced(F.array(
            F.concat(F.repeat(F.lit("#"), block["level"]), F.lit(" "), text)))).otherwise(none))
        .when(kind == "paragraph", F.when(T.strip(text) != "", F.concat(paragraph, gap) if strict else paragraph).otherwise(none))
        .when(kind == "quote", F.when(text != "", spaced(quote)).otherwise(none))
        .when(kind == "gap", gap)
        .when(kind == "item", F.when(text != "", F.array(
            F.concat(F.repeat(F.lit("  "), block["level"]), extra, F.lit(" "), text))).otherwise(none))
        .when(kind == "code", spaced(F.array(F.concat(F.lit("```"), extra), text, F.lit("```"))))
        .when(kind == "image", F.array(image))
        .when(kind == "caption", F.array(F.concat(F.lit("*"), text, F.lit("*"))))
        .when(kind == "table", spaced(H.table_lines(cells)))
        .when(kind == "rule", spaced(F.array(F.lit("---"))))
        .when(kind == "term", F.when(text != "", F.array(F.concat(F.lit("**"), text, F.lit("**")))).otherwise(none))
        .when(kind == "definition", F.when(text != "", F.array(F.concat(F.lit(": "), text))).otherwise(none))
        .otherwise(none)
    )


def render_blocks(blocks: Column | str, name: str) -> Column:
    """Blocks to Markdown text, runs of blank lines collapsed."""
    lines = F.flatten(F.transform(T.as_col(blocks), lambda b: _lines(b, name)))
    return T.collapse_blank_lines(F.array_join(lines, "\n"))


def pages_to_markdown(
    pages: DataFrame, profile: str = "article_page", html: str = "html", into: str = "content",
    class_match: str | None = None,
) -> DataFrame:
    """Add the Markdown of an HTML column."""
    blocks = html_blocks(html, profile_of(profile, class_match))
    return pages.withColumn("_blocks", blocks).withColumn(
        into, render_blocks("_blocks", profile)).drop("_blocks")


def extract_articles(
    pages: DataFrame, profile: str = "article_page", html: str = "html",
    min_html: int = V.MIN_HTML, min_text: int = V.MIN_ARTICLE,
) -> DataFrame:
    """Pages with ``content``, its counts and ``reject``; rejected pages stay with their reason."""
    gated = quality_gate(
        pages_to_markdown(pages, profile, html), html=html, min_html=min_html, min_text=min_text)
    return gated.withColumns({"word_count": T.word_count("content"), "char_count": T.char_count("content")})
