"""HTML functions for flat structures: tags, entities, meta fields, lists, tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import values as V
from gleaner.functions.text import (
    append_absent, as_col, before_pipe, collapse_blank_lines, extract, iso_date_prefix, keyword_list, let,
    nullif_blank, strip,
    strip_site_suffix, truncate_desc,
)

TAG = r"<[^>]*>"


def strip_tags(html: Column | str) -> Column:
    return F.regexp_replace(as_col(html), TAG, "")


# Every name of HTML5, by the standard library: with a semicolon, and those that may lack it.
_NAMES = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
_OPEN = sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n))
_ENTITY = r"&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*;|(?:" + "|".join(_OPEN) + "))"
# Numbers 128 to 159 stand for characters of the Windows code page, as in the standard library.
_WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}


def unescape(text: Column | str) -> Column:
    """Resolve named, decimal and hexadecimal entities, each once; what is no entity stays.

    The text is split at its entities and put together again with what they stand for. An open name
    before other letters (``&copyright;``) counts as well; numbers that name no character give ``\ufffd``.
    """
    names = F.from_json(F.lit(json.dumps(_NAMES)), "map<string,string>")
    windows = F.from_json(F.lit(json.dumps(_WINDOWS)), "map<string,string>")

    def numbered(entity: Column) -> Column:
        digits = F.regexp_extract(entity, "^&#[xX]?([0-9a-fA-F]+)", 1)
        code = F.when(entity.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")

        def point(n: Column) -> Column:
            valid = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
            char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
            return F.when(valid, F.coalesce(F.try_element_at(windows, n.cast("string")), char)).otherwise("\ufffd")

        return let(F.coalesce(code, F.lit(-1).cast("long")), point)

    def resolve(entity: Column) -> Column:
        name = F.regexp_extract(entity, "^&([A-Za-z0-9]+)", 1)
        opened = F.regexp_extract(entity, f"^&({'|'.join(_OPEN)})(.*)$", 1)
        rest = F.when(opened != "", F.concat(F.try_element_at(names, opened), F.substr(entity, F.length(opened) + 2)))
        return F.when(entity.startswith("&#"), numbered(entity)).otherwise(
            F.coalesce(F.try_element_at(names, name), rest, entity))

    def join(raw: Column) -> Column:
        gaps = F.split(raw, _ENTITY, -1)
        found = F.concat(F.transform(F.regexp_extract_all(raw, F.lit(_ENTITY), F.lit(0)), resolve), F.array(F.lit("")))
        whole = F.array_join(F.zip_with(gaps, found, lambda g, e: F.concat(g, F.coalesce(e, F.lit("")))), "")
        return F.when(raw.contains("&"), whole).otherwise(raw)

    return let(as_col(text), join)


#: A value in either quotes or bare, in three groups.
_VALUE = r"""(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
#: A start tag's attributes: quoted values may hold an end of tag.
_REST = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""


def attribute(tag: Column, name: str) -> Column:
    """Raw value of an attribute of a start tag, in either quotes or bare; empty if absent."""
    value = F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    return F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")


def with_class(name: str) -> str:
    """Pattern of a class attribute that holds a class, in either quotes or bare."""
    return (rf"""\sclass\s*=\s*(?:"(?:[^"]*\s)?{name}(?:\s[^"]*)?"|'(?:[^']*\s)?{name}(?:\s[^']*)?'|{name}(?=[\s>/]))""")


def visible_text(html: Column | str) -> Column:
    """Text of a snippet: tags off, entities resolved, ends trimmed."""
    return strip(unescape(strip_tags(html)))


def description_text(html: Column | str) -> Column:
    return truncate_desc(visible_text(html))


def tag_text(html: Column | str, tag: str) -> Column:
    """Text of the first element of a kind; null if absent or blank."""
    return nullif_blank(visible_text(extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>")))


def class_text(html: Column | str, name: str, tag: str = r"\w+") -> Column:
    """Text of the first element with a class; null if absent or blank."""
    pattern = rf"(?is)<({tag})(?=\s)[^>]*?{with_class(name)}[^>]*>(.*?)</\1\s*>"
    return nullif_blank(visible_text(extract(html, pattern, 2)))


def metas(html: Column | str) -> Column:
    """``array<struct<property,name,content>>`` of all meta tags that have content, in order."""

    tags = F.regexp_extract_all(as_col(html), F.lit(rf"(?is)<meta\s{_REST}>"), F.lit(0))
    fields = F.transform(tags, lambda t: F.struct(
        attribute(t, "property").alias("property"), attribute(t, "name").alias("name"),
        strip(unescape(attribute(t, "content"))).alias("content")))
    return F.filter(fields, lambda m: m["content"] != "")


def meta(tags: Column | str, name: str) -> Column:
    """Content of the first meta tag of a name, ``property`` before ``name``."""
    tags = as_col(tags)
    by_property = F.filter(tags, lambda m: m["property"] == name)
    by_name = F.filter(tags, lambda m: m["name"] == name)
    return F.coalesce(F.get(by_property, F.lit(0))["content"], F.get(by_name, F.lit(0))["content"])


def meta_all(tags: Column | str, name: str) -> Column:
    """Content of every meta tag with that property."""
    return F.transform(F.filter(as_col(tags), lambda m: m["property"] == name), lambda m: m["content"])


def paragraphs(html: Column | str) -> Column:
    """Inner HTML of each ``<p>``; the next ``<p>``, any ``</p>`` or the end of its section ends it."""
    pieces = F.split(as_col(html), r"(?i)<p(?:\s[^>]*)?>")
    rest = let(pieces, lambda x: F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))))
    return F.transform(rest, lambda p: F.get(F.split(p, r"(?i)</(?:p|article|section|main|body|html)\s*>", 2), F.lit(0)))


def paragraph_texts(html: Column | str) -> Column:
    return F.transform(paragraphs(html), visible_text)


def list_items(html: Column | str) -> Column:
    """Inner HTML of each flat ``<li>``, in order."""
    return F.regexp_extract_all(as_col(html), F.lit(r"(?is)<li(?:\s[^>]*)?>(.*?)</li>"), F.lit(1))


def anchors(html: Column | str) -> Column:
    """``array<struct<href,title,text>>`` of all links with a target."""
    whole = F.regexp_extract_all(
        as_col(html), F.lit(rf"(?is)<a(?=\s)[^>]*?[\s\"']href\s*={_REST}>.*?</a\s*>"), F.lit(0)
    )
    return F.transform(
        whole,
        lambda a: F.struct(
            unescape(attribute(F.regexp_extract(a, rf"(?is)^<a{_REST}>", 0), "href")).alias("href"),
            nullif_blank(attribute(F.regexp_extract(a, rf"(?is)^<a{_REST}>", 0), "title")).alias("title"),
            visible_text(a).alias("text"),
        ),
    )


def remove_elements(html: Column | str, gone: Callable[[Column, Column], Column]) -> Column:
    """The text without the elements that ``gone(start tag, its name)`` names, with all that stands in them.

    The text is cut before every tag. An element ends at the end tag of its name behind which as many elements
    of that name have ended as have started; one that never ends stays. Tags that end in ``/>`` start nothing.
    """
    def cut(pieces: Column) -> Column:
        def mark(piece: Column, at: Column) -> Column:
            tag = F.regexp_extract(piece, rf"(?is)^</?[a-z]{_REST}>", 0)
            name = F.when(~tag.endswith("/>"), F.lower(F.regexp_extract(tag, r"^</?([^\s/>]+)", 1)))
            return F.struct(at.alias("at"), name.alias("name"), tag.startswith("</").alias("ends"), tag.alias("tag"))

        def end_of(start: Column, marks: Column) -> Column:
            same = F.filter(marks, lambda m: (m["at"] >= start["at"]) & (m["name"] == start["name"]))
            places = F.filter(F.transform(same, lambda m, i: F.struct(m["at"].alias("at"), m["ends"].alias("ends"), i.alias("i"))), lambda m: m["ends"])
            # before the b-th end tag, from 0, stand b others; the depth behind it is its place less 2 b + 1
            closing = F.filter(F.transform(places, lambda m, b: F.when(m["i"] == 2 * b + 1, m["at"])), lambda x: x.isNotNull())
            return F.struct(start["at"].alias("start"), F.get(closing, F.lit(0)).alias("end"))

        def drop(ranges: Column) -> Column:
            def keep(piece: Column, at: Column) -> Column:
                inside = F.exists(ranges, lambda r: (at >= r["start"]) & (at < r["end"]))
                closes = F.exists(ranges, lambda r: at == r["end"])
                return F.when(inside, "").when(closes, F.regexp_replace(piece, r"(?s)^</[^>]*>", "")).otherwise(piece)

            return F.array_join(F.transform(pieces, keep), "")

        def ranges_of(marks: Column) -> Column:
            starts = F.filter(marks, lambda m: ~m["ends"] & gone(m["tag"], m["name"]))
            found = F.transform(starts, lambda start: end_of(start, marks))
            return F.filter(found, lambda r: r["end"].isNotNull())

        return let(let(F.transform(pieces, mark), ranges_of), drop)

    return let(F.split(as_col(html), rf"(?is)(?=</?[a-z]{_REST}>)", -1), cut)


def remove_chrome(
    html: Column | str,
    tags: tuple[str, ...] = ("nav", "footer", "aside", "script", "style", "noscript", "svg"),
    ids: tuple[str, ...] = (),
    classes: tuple[str, ...] = (),
) -> Column:
    """Delete chrome elements by tag, id or exact class, with all elements that stand in them."""
    def gone(tag: Column, name: Column) -> Column:
        found = name.isin(*tags) if tags else F.lit(False)
        if ids:
            found |= attribute(tag, "id").isin(*ids)
        if classes:
            found |= F.arrays_overlap(F.split(attribute(tag, "class"), r"\s+"), F.array(*map(F.lit, classes)))
        return F.coalesce(found, F.lit(False))

    return remove_elements(html, gone)


# -- inline markup ----------------------------------------------------------------

def inline_markdown(html: Column | str) -> Column:
    """Flat inline markup: bold, italic, code, link, break, image; other tags drop."""
    steps = [
        (r"(?is)<(?:strong|b)(?:\s[^>]*)?>\s*(\S.*?)\s*</(?:strong|b)>", "**$1**"),
        (r"(?is)<(?:em|i)(?:\s[^>]*)?>\s*(\S.*?)\s*</(?:em|i)>", "*$1*"),
        (r"(?is)<code(?:\s[^>]*)?>\s*(\S.*?)\s*</code>", "`$1`"),
        (r"""(?is)<a(?=\s)[^>]*?\shref\s*=\s*(?:"([^"]+)"|'([^']+)'|([^\s>"']+))[^>]*>\s*(\S.*?)\s*</a\s*>""", "[$4]($1$2$3)"),
        (r"(?i)<br\s*/?>", "\n"),
        (rf"(?is)<img(?={_REST}\salt\s*=\s*{_VALUE})(?={_REST}\ssrc\s*=\s*{_VALUE}){_REST}>", "![$1$2$3]($4$5$6)"),
        (rf"(?is)<img(?={_REST}\ssrc\s*=\s*{_VALUE}){_REST}>", "![]($1$2$3)"),
    ]
    marked = reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, as_col(html))
    return unescape(strip_tags(marked))


def table_rows(table_html: Column | str) -> Column:
    """``array<array<string>>`` of cell texts, pipes escaped, rows without cells dropped."""
    # a row or a cell ends at its end tag or where the next one, or the table, does
    rows = F.regexp_extract_all(
        as_col(table_html), F.lit(r"(?is)<tr(?:\s[^>]*)?>(.*?)(?=</tr|<tr[\s>]|</t(?:able|body|head|foot)|$)"), F.lit(1))
    cells = F.transform(
        rows,
        lambda r: F.transform(
            F.regexp_extract_all(r, F.lit(r"(?is)<t[hd](?:\s[^>]*)?>(.*?)(?=</t[hd]|<t[hd][\s>]|$)"), F.lit(1)),
            lambda c: F.replace(visible_text(c), F.lit("|"), F.lit("\\|")),
        ),
    )
    return F.filter(cells, lambda r: F.size(r) > 0)


def table_lines(rows: Column | str) -> Column:
    """Markdown lines of a table: header, rule, body; rows padded to the widest."""

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def render(rows: Column) -> Column:
        def padded(widest: Column) -> Column:
            body = F.transform(
                rows, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), widest - F.size(r)))))
            rule = F.array(line(F.array_repeat(F.lit("---"), widest)))
            return let(body, lambda b: F.concat(
                F.slice(b, 1, 1), rule, F.slice(b, 2, F.greatest(F.size(b), F.lit(1)))))

        widest = F.array_max(F.transform(rows, lambda r: F.size(r)))
        return F.when(F.size(rows) > 0, let(widest, padded)).otherwise(F.array().cast("array<string>"))

    return let(as_col(rows), render)


def table_markdown(table_html: Column | str) -> Column:
    return F.array_join(table_lines(table_rows(table_html)), "\n")


# -- callouts ---------------------------------------------------------------------

def callout_type(classes: Column | str, text: Column | str) -> Column:
    """Callout kind by class, then by leading word; null for a plain quote."""

    def test(pair: Column) -> Column:
        names, head = pair["names"], pair["head"]
        tests = [F.when(names.contains(word), kind) for word, kind in V.CALLOUTS.items()]
        tests += [
            F.when(head.startswith(word + ":") | head.startswith(word + " "), kind)
            for word, kind in V.CALLOUTS.items()
        ]
        return F.coalesce(*tests)

    names = F.lower(F.coalesce(as_col(classes), F.lit("")))
    head = F.lower(F.left(as_col(text), F.lit(50)))
    return let(F.struct(names.alias("names"), head.alias("head")), test)


def callout_body(text: Column | str) -> Column:
    """Text without its leading label."""

    def cut(whole: Column) -> Column:
        result = whole
        for label in reversed(V.CALLOUT_LABELS):
            rest = strip(F.ltrim(F.substr(whole, F.lit(len(label) + 1)), F.lit(":")))
            result = F.when(whole.startswith(label), rest).otherwise(result)
        return result

    return let(as_col(text), cut)


def quote_lines(text: Column | str) -> Column:
    lines = F.filter(F.transform(F.split(as_col(text), "\n"), strip), lambda x: x != "")
    return F.transform(lines, lambda x: F.concat(F.lit("> "), x))


# -- document fields --------------------------------------------------------------

def title_sources(html: Column | str, tags: Column | str) -> dict[str, Column]:
    """Where a page may name its title; null where it does not."""
    title = tag_text(html, "title")
    return {
        "og": meta(tags, "og:title"),
        "h1": tag_text(html, "h1"),
        "topic": class_text(html, "topictitle", "h1"),
        "title": nullif_blank(strip_site_suffix(title)),
        "before_pipe": nullif_blank(before_pipe(title)),
        "raw_title": title,
    }


def page_title(html: Column | str, tags: Column | str, order: tuple[str, ...] = ("og", "h1", "title")) -> Column:
    """Title by the site's order of sources; a title tag loses its site suffix."""
    sources = title_sources(html, tags)
    return F.coalesce(*[sources[name] for name in order])


def title_by_order(html: Column | str, order: Column | str) -> Column:
    """Title by an order of sources that is a column."""
    html = as_col(html)

    def pick(tags: Column) -> Column:
        pairs = [x for name, value in title_sources(html, tags).items() for x in (F.lit(name), value)]
        return let(F.create_map(*pairs), lambda m: F.get(F.array_compact(
            F.transform(as_col(order), lambda name: F.try_element_at(m, name))), F.lit(0)))

    return let(metas(html), pick)


def page_date(html: Column | str, tags: Column | str) -> Column:
    names = ["article:published_time", "article:published", "datePublished", "date"]
    stamp = nullif_blank(attribute(F.regexp_extract(as_col(html), rf"(?is)<time(?=\s)[^>]*?\sdatetime\s*={_REST}>", 0), "datetime"))
    dates = [iso_date_prefix(meta(tags, n)) for n in names]
    return F.coalesce(*dates, iso_date_prefix(stamp), iso_date_prefix(tag_text(html, "time")))


def page_meta(
    html: Column | str, order: tuple[str, ...] = ("og", "h1", "title")
) -> Column:
    """``struct<title, authors, date, description, categories>`` of a page.

    Linked data goes before meta tags for date and authors. Meta tags are read once.
    """
    html = as_col(html)

    def fields(pair: Column) -> Column:
        tags, linked = pair["tags"], pair["linked"]
        author = F.coalesce(meta(tags, "author"), meta(tags, "article:author"))
        authors = F.when(F.size(linked["authors"]) > 0, linked["authors"]).when(author.isNotNull(), F.array(author))
        return F.struct(
            page_title(html, tags, order).alias("title"),
            F.coalesce(authors, F.array().cast("array<string>")).alias("authors"),
            F.coalesce(linked["date"], page_date(html, tags)).alias("date"),
            F.coalesce(meta(tags, "og:description"), meta(tags, "description"), F.lit("")).alias("description"),
            append_absent(keyword_list(meta(tags, "keywords")), meta_all(tags, "article:tag")).alias("categories"),
        )

    none = F.struct(F.lit(None).cast("date").alias("date"), F.array().cast("array<string>").alias("authors"))
    linked = F.when(html.contains("ld+json"), json_ld(html)).otherwise(none)
    return let(F.struct(metas(html).alias("tags"), linked.alias("linked")), fields)


_LD_AUTHOR = "struct<name:string>"
_LD_ONE = f"struct<datePublished:string,dateCreated:string,author:{_LD_AUTHOR}>"
_LD_MANY = f"struct<datePublished:string,dateCreated:string,author:array<{_LD_AUTHOR}>>"


def json_ld(html: Column | str) -> Column:
    """``struct<date, authors>`` from linked-data scripts; the first script with a value wins."""
    scripts = F.regexp_extract_all(
        as_col(html),
        F.lit(r"""(?is)<script[^>]*\stype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>"""),
        F.lit(1),
    )

    def read(script: Column) -> Column:
        body = F.when(F.ltrim(script, F.lit(V.WHITESPACE)).startswith("["),
                      F.get_json_object(script, "$[0]")).otherwise(script)
        fields = F.from_json(body, "struct<datePublished:string,dateCreated:string>")
        author = strip(F.get_json_object(body, "$.author"))
        names = F.when(
            author.startswith("["),
            F.transform(F.from_json(author, f"array<{_LD_AUTHOR}>"), lambda a: a["name"]),
        ).when(author.startswith("{"), F.array(F.from_json(author, _LD_AUTHOR)["name"]))
        stamp = F.coalesce(nullif_blank(fields["datePublished"]), nullif_blank(fields["dateCreated"]))
        return F.struct(
            iso_date_prefix(stamp).alias("date"),
            (author.isNotNull() & ~author.isin("", "{}", "[]")).alias("has_author"),
            F.filter(names, lambda n: n.isNotNull() & (n != "")).alias("authors"),
        )

    parsed = F.transform(scripts, read)
    dated = F.filter(parsed, lambda s: s["date"].isNotNull())
    signed = F.filter(parsed, lambda s: s["has_author"])
    return F.struct(
        F.get(dated, F.lit(0))["date"].alias("date"),
        F.coalesce(F.get(signed, F.lit(0))["authors"], F.array().cast("array<string>")).alias("authors"),
    )


# -- component markup ---------------------------------------------------------------

def _mdx_callout(text: Column, tag: str, kind: str) -> Column:
    """``<tag>…</tag>`` blocks as quoted callouts; a block without its end stays as it is."""

    def quote(piece: Column) -> Column:
        def render(halves: Column) -> Column:
            body = F.replace(strip(F.get(halves, F.lit(0))), F.lit("\r\n"), F.lit("\n"))
            lines = F.concat(F.lit("> "), F.replace(body, F.lit("\n"), F.lit("\n> ")))
            return F.when(
                F.size(halves) == 2, F.concat(F.lit(f"> [!{kind}]\n"), lines, F.get(halves, F.lit(1)))
            ).otherwise(F.concat(F.lit(f"<{tag}>"), piece))

        return let(F.split(piece, f"</{tag}>", 2), render)

    def rebuild(pieces: Column) -> Column:
        rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), quote)
        return F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, ""))

    return let(text, lambda t: F.when(t.contains(f"<{tag}>"), let(F.split(t, f"<{tag}>"), rebuild)).otherwise(t))


def mdx_clean(text: Column | str) -> Column:
    """Markdown with component tags -> plain Markdown with callouts and headings; absent tags cost no pattern."""

    def titled(whole: Column, tag: str, pattern: str, shown: str) -> Column:
        return let(whole, lambda t: F.when(t.contains(f"<{tag}"), F.regexp_replace(t, pattern, shown)).otherwise(t))

    result = F.regexp_replace(as_col(text), V.MDX_INDEX, "")
    for tag, kind in V.MDX_CALLOUTS.items():
        result = _mdx_callout(result, tag, kind)
    for tag, mark in (("Accordion", "###"), ("Tab", "####")):
        pattern, shown = V.MDX_TITLED.format(tag=tag), f"{mark} $1\n\n$2"
        result = titled(result, tag, pattern, shown)
    result = F.regexp_replace(result, V.MDX_CONTAINER.format(names="|".join(V.MDX_CONTAINERS)), "")
    result = F.regexp_replace(result, V.MDX_OTHER, "")
    return collapse_blank_lines(result)
