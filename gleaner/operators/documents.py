"""Document jobs: chapters, paragraph JSON, transcripts, old chapter files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import values as V
from gleaner.functions import html as H
from gleaner.functions import notes as N
from gleaner.functions import text as T
from gleaner.operators.markdown import element_paragraphs, pages_to_markdown
from gleaner.operators.selection import drop_boilerplate, quality_gate


def container(html: Column | str, tag: str) -> Column:
    """Inner HTML from the first element of a kind to the last end tag of that kind."""
    return T.extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*)</{tag}>")


def _story(paragraphs: Column, phrases: list[str] | None, head: int | None) -> Column:
    """Story paragraphs, boilerplate dropped, joined by blank lines."""
    kept = drop_boilerplate(paragraphs, phrases, head=head) if phrases else F.filter(
        paragraphs, lambda p: F.length(p) > V.MIN_PARAGRAPH)
    return F.array_join(kept, "\n\n")


def chapter_text(
    html: Column | str, phrases: list[str] | None, selectors: tuple[str, ...] = (), head: int | None = None
) -> Column:
    """Story paragraphs of the first selector's element that the page has, or of the whole page without selectors."""
    found = element_paragraphs(html, {"": list(selectors) or [""]}, F.lit(""))
    first = F.get(F.filter(found, lambda ps: ps.isNotNull()), F.lit(0))
    return T.let(first, lambda ps: _story(ps, phrases, head))


def chapter_page_title(html: Column | str, selectors: list[str]) -> Column:
    """Text of the first selector that has some, else ``Chapter``."""
    found = []
    for selector in selectors:
        tag, _, name = selector.partition(".")
        found.append(H.class_text(html, name, tag or r"\w+") if name else H.tag_text(html, tag))
    return F.coalesce(*found, F.lit("Chapter"))


def _stories(found: str, phrases: list[str] | None, head: int | None) -> Column:
    """The story of each selector's element that the page has."""
    return F.transform(F.filter(found, lambda ps: ps.isNotNull()), lambda ps: _story(ps, phrases, head))


def read_chapters(pages: DataFrame) -> DataFrame:
    """``pages(site, html, …)`` with ``title``, ``content`` and ``reject`` by their site's rules.

    A selector whose element holds no story paragraph gives way to the next one. The
    content must be longer than the site's gate.
    """
    site = F.col("site")
    title = content = F.lit(None).cast("string")
    gate = F.lit(None).cast("int")
    selectors = {name: list(found) or [""] for name, found in V.CHAPTER_TEXTS.items()}
    for name in selectors:
        phrases, head = V.BOILERPLATE.get(name), V.BOILERPLATE_HEAD.get(name)
        texts = _stories("_found", phrases, head)
        content = F.when(site == name, F.get(F.filter(texts, lambda t: t != ""), F.lit(0))).otherwise(content)
        title = F.when(site == name, chapter_page_title("html", V.CHAPTER_TITLES[name])).otherwise(title)
        gate = F.when(site == name, V.CHAPTER_GATES[name]).otherwise(gate)
    found = pages.withColumn("_found", element_paragraphs("html", selectors, "site"))
    read = found.withColumns({"title": title, "content": content}).drop("_found")
    length = F.coalesce(F.length("content"), F.lit(0))
    reject = F.when(gate.isNull(), "unknown site").when(length <= gate, F.format_string("text has %d chars (above %d)", length, gate))
    return read.withColumn("reject", reject)


# -- paragraphs with markups -----------------------------------------------------------

PARAGRAPHS = (
    "array<struct<text:string,type:string,href:string,metadata:struct<id:string>,"
    "markups:array<struct<type:string,start:int,end:int,href:string>>>>"
)


def apply_markups(text: Column, markups: Column) -> Column:
    """Wrap marked spans, from the last start to the first.

    Positions count code points of the text as it stands: an outer span keeps its
    numbers after an inner one was widened.
    """
    placed = F.transform(markups, lambda m, i: F.struct(
        (-F.coalesce(m["start"], F.lit(0))).alias("key"), i.alias("i"), m.alias("m")))

    def wrap(acc: Column, item: Column) -> Column:
        mark = item["m"]
        start, end = F.coalesce(mark["start"], F.lit(0)), F.coalesce(mark["end"], F.lit(0))
        span = F.substr(acc, start + 1, F.greatest(end - start, F.lit(0)))
        href = F.coalesce(mark["href"], F.lit(""))
        wrapped = (
            F.when(mark["type"] == "STRONG", F.concat(F.lit("**"), span, F.lit("**")))
            .when(mark["type"] == "EM", F.concat(F.lit("*"), span, F.lit("*")))
            .when(mark["type"] == "CODE", F.concat(F.lit("`"), span, F.lit("`")))
            .when((mark["type"] == "A") & (href != ""), F.concat(F.lit("["), span, F.lit("]("), href, F.lit(")")))
        )
        merged = F.concat(F.substr(acc, F.lit(1), start), wrapped, F.substr(acc, F.greatest(end, start) + 1))
        return F.when((T.strip(span) == "") | wrapped.isNull(), acc).otherwise(merged)

    return F.reduce(F.sort_array(F.coalesce(placed, F.array())), text, wrap)


def _paragraph_lines(p: Column) -> Column:
    raw = F.coalesce(p["text"], F.lit(""))
    kind, href = p["type"], F.coalesce(p["href"], F.lit(""))
    text = F.when((raw != "") & (F.size(p["markups"]) > 0), apply_markups(raw, p["markups"])).otherwise(raw)
    gap, none = F.array(F.lit("")), F.array().cast("array<string>")
    image = T.nullif_blank(p["metadata"]["id"])

    def spaced(*lines: Column) -> Column:
        return F.concat(gap, *lines, gap)

    return (
        F.when(kind == "P", F.array(F.lit(""), text))
        .when(kind == "H3", spaced(F.array(F.concat(F.lit("## "), text))))
        .when(kind == "H4", spaced(F.array(F.concat(F.lit("### "), text))))
        .when(kind == "IMG", F.when(image.isNotNull(), spaced(F.array(
            F.concat(F.lit("!["), text, F.lit(f"]({V.IMAGE_BASE}"), image, F.lit(")"))))).otherwise(none))
        .when(kind == "BQ", spaced(H.quote_lines(text)))
        .when(kind == "ULI", F.array(F.concat(F.lit("- "), text)))
        .when(kind == "OLI", F.array(F.concat(F.lit("1. "), text)))
        .when(kind == "PRE", spaced(F.array(F.lit("```"), raw, F.lit("```"))))
        .when(kind == "MIXTAPE_EMBED", F.when(href != "", spaced(F.array(
            F.concat(F.lit("["), F.coalesce(T.nullif_blank(text), href), F.lit("]("), href, F.lit(")"))))).otherwise(none))
        .otherwise(F.when(text != "", F.array(F.lit(""), text)).otherwise(none))
    )


def paragraphs_markdown(body: Column | str) -> Column:
    """Markdown of a paragraph list in JSON; headers before the first other paragraph drop.

    Fewer than three paragraphs are no article and give null.
    """
    items = F.from_json(T.as_col(body), PARAGRAPHS)
    other = F.array_position(
        F.transform(items, lambda p: ~F.coalesce(p["type"], F.lit("")).isin("H3", "H4")), True)
    kept = F.when(other > 0, F.slice(items, other.cast("int"), F.size(items))).otherwise(F.slice(items, 1, 0))
    lines = F.flatten(F.transform(kept, _paragraph_lines))
    return F.when(
        F.size(items) >= V.MIN_PARAGRAPHS_JSON, T.collapse_blank_lines(F.array_join(lines, "\n")))


# -- transcripts and old files -----------------------------------------------------------

def transcript_lines(videos: DataFrame, snippets: DataFrame) -> DataFrame:
    """``(video_id, ord, line)``: the note's head, then one row per snippet; blank lines stand between.

    The form is the same at every length; ``write_line_files`` makes one note of each video.
    Videos without a snippet have no note, snippets of unknown videos neither.
    """
    spoken = videos.join(snippets.select("video_id"), "video_id", "left_semi")
    heads = spoken.select(
        "video_id", F.lit(-1).cast("long").alias("ord"),
        N.transcript_head(F.col("title"), F.col("url"), F.col("author")).alias("line"))
    known = snippets.join(videos.select("video_id"), "video_id", "left_semi")
    return heads.unionByName(known.select("video_id", F.col("ord").cast("long").alias("ord"), F.col("text").alias("line")))


def convert_old_chapters(files: DataFrame, min_chars: int = V.MIN_CHAPTER) -> DataFrame:
    """Old chapter files ``(novel, name, content)`` as new notes ``(novel, num, path, content, reject)``.

    Index and collected files and names without a number are no chapters.
    """
    name = F.col("name")
    is_chapter = name.endswith(".md") & ~name.endswith("_Index.md") & ~name.endswith("_Complete.md")
    chapters = files.filter(is_chapter).withColumn("num", T.chapter_no_from_file(name)).filter("num IS NOT NULL")
    folder = T.title_case(T.sanitize_filename("novel"), underscores=True)
    body = chapters.withColumn("body", T.drop_first_heading(T.strip_front_matter("content")))
    gated = quality_gate(body, text="body", min_text=min_chars)
    return gated.select(
        "novel", "num", F.concat(folder, F.lit("/"), T.chapter_file(folder, "num")).alias("path"),
        N.chapter_note(folder, T.kebab_case("novel"), "num", "body").alias("content"), "reject")


def article_notes(articles: DataFrame, created: Column, tags: Column) -> DataFrame:
    """``(url, content)``: front matter, the summary's Markdown if there is one, the article's Markdown."""
    both = pages_to_markdown(
        pages_to_markdown(articles, "article", "body_html", "body_md"), "article", "summary_html", "summary_md")
    head = N.front_matter(
        F.col("title"), F.col("url"), created, tags, F.col("authors"), F.col("date"), F.col("description"))
    return both.select("url", N.article_note(head, F.col("body_md"), F.col("summary_md")).alias("content"))
