"""Text, name, number and date functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import values as V

WS = r"(?U)\s+"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for a ``body`` that uses it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def one_if(value: Column, test: Callable[[Column], Column]) -> Column:
    """Generator: ``value`` if it passes, else no row.

    A filter on a parsed value would be pushed below the parse and parse again; a
    generator is evaluated once.
    """
    return F.explode(F.filter(F.array(value), test))


def strip(text: Column | str) -> Column:
    """Remove white space of any kind at both ends (``trim`` alone takes spaces only)."""
    return F.btrim(as_col(text), F.lit(V.WHITESPACE))


def collapse_spaces(text: Column | str) -> Column:
    return strip(F.regexp_replace(as_col(text), WS, " "))


def nullif_blank(text: Column | str) -> Column:
    """Empty string counts as absent."""
    return F.nullif(as_col(text), F.lit(""))


def extract(text: Column | str, pattern: str, group: int = 1) -> Column:
    """``regexp_extract`` that gives null, not '', where nothing matches."""
    return nullif_blank(F.regexp_extract(as_col(text), pattern, group))


# -- names -----------------------------------------------------------------

def sanitize_filename(name: Column | str, max_len: int | None = None) -> Column:
    safe = collapse_spaces(F.translate(as_col(name), V.UNSAFE, ""))
    return F.left(safe, F.lit(max_len)) if max_len else safe


def sanitize_segment(name: Column | str) -> Column:
    """File-name rule of hierarchical pages: slashes stay, blank becomes ``index``."""
    safe = collapse_spaces(F.translate(as_col(name), V.UNSAFE_IN_SEGMENT, ""))
    return F.coalesce(nullif_blank(safe), F.lit("index"))


def folder_key(name: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.translate(as_col(name), V.UNSAFE, ""), WS, "_"))


def title_case(name: Column | str, underscores: bool = False) -> Column:
    base = F.translate(as_col(name), "_", " ") if underscores else as_col(name)
    return F.initcap(collapse_spaces(base))


def kebab_case(name: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.translate(as_col(name), V.UNSAFE + "'", ""), WS, "-"))


def folder_name(name: Column | str) -> Column:
    return title_case(sanitize_filename(name))


def chapter_link(folder: Column | str, num: Column | str) -> Column:
    """``0001 - Folder``; ``format_string`` keeps numbers above four digits whole."""
    return F.format_string("%04d - %s", as_col(num).cast("long"), as_col(folder))


def chapter_file(folder: Column | str, num: Column | str) -> Column:
    return F.concat(chapter_link(folder, num), F.lit(".md"))


def index_link(folder: Column | str) -> Column:
    return F.concat(F.translate(as_col(folder), " ", "_"), F.lit("_Index"))


def titled_chapter_file(num: Column | str, title: Column | str) -> Column:
    return F.format_string(
        "Chapter %03d - %s.md", as_col(num).cast("long"), sanitize_filename(title)
    )


# -- chapter numbers and titles ---------------------------------------------

def chapter_no(text: Column | str, href: Column | str) -> Column:
    return F.coalesce(
        extract(text, r"(?iU)Chapter\s*(\d+)"), extract(href, r"(?i)chapter-?(\d+)")
    ).try_cast("long")


def chapter_no_from_page(title: Column | str, first_paragraph: Column | str) -> Column:
    patterns = [r"(?i)Chapter\s+(\d+)", r"(?i)Ch\.?\s*(\d+)", r"(?i)chapter-(\d+)"]
    sources = [as_col(title), as_col(first_paragraph)]
    return F.coalesce(*[extract(s, p) for s in sources for p in patterns]).try_cast("long")


def chapter_no_from_file(name: Column | str) -> Column:
    patterns = [r"^Chapter_(\d+)", r"^Chapter\s+(\d+)\s*-", r"^(\d+)\s*-"]
    return F.coalesce(*[extract(name, p) for p in patterns]).try_cast("long")


def chapter_title(page_title: Column | str, novel: Column | str, num: Column | str) -> Column:
    title, novel = as_col(page_title), as_col(novel)
    numbered = F.concat(F.lit("Chapter "), as_col(num).cast("string"))
    after = F.element_at(F.split(title, " - Chapter "), 2)
    head = F.substring_index(title, " | ", 1)
    proper = F.initcap(novel)
    plain = (
        F.when(head.contains(novel), F.replace(head, F.concat(novel, F.lit(" - ")), F.lit("")))
        .when(head.contains(proper), F.replace(head, F.concat(proper, F.lit(" - ")), F.lit("")))
        .otherwise(head)
    )
    return (
        F.when(
            title.contains(" - Chapter "),
            F.concat(F.lit("Chapter "), F.substring_index(after, " | ", 1)),
        )
        .when(title.contains("Chapter"), plain)
        .otherwise(numbered)
    )


def series_part(title: Column | str) -> Column:
    """``struct<base, part>`` of a title that names a part of a series, else null."""
    forms = [f"(?iU){form}" for form in V.SERIES_FORMS]

    def number_of(part: Column) -> Column:
        numerals = F.create_map(*[F.lit(x) for pair in V.ROMAN.items() for x in pair])
        return let(part, lambda p: F.coalesce(
            F.try_element_at(numerals, p), F.when(p.rlike(r"^\d+$"), p.try_cast("int"))))

    def numbered(base: Column) -> Callable[[Column], Column]:
        return lambda n: F.when(n.isNotNull(), F.struct(base.alias("base"), n.alias("part")))

    def match(text: Column) -> Column:
        found = []
        for form in forms:
            base = strip(F.regexp_extract(text, form, 1))
            number = number_of(F.upper(F.regexp_extract(text, form, 2)))
            found.append(let(number, numbered(base)))
        return F.when(F.lower(text).contains("part"), F.coalesce(*found))

    return let(strip(title), match)


# -- dates -------------------------------------------------------------------

def iso_date_prefix(text: Column | str) -> Column:
    return F.try_to_date(extract(text, r"^(\d{4}-\d{2}-\d{2})"), "yyyy-MM-dd")


def rfc2822_date(text: Column | str) -> Column:
    """Date of an RFC 2822 stamp in the stamp's own zone; ISO prefix as fallback."""
    stamp = extract(text, r"(\d{1,2} [A-Z][a-z]{2} \d{4}) \d{2}:\d{2}")
    return F.coalesce(F.try_to_date(stamp, "d MMM yyyy"), iso_date_prefix(text))


def day(stamp: Column | str) -> Column:
    return F.date_format(as_col(stamp), "yyyy-MM-dd")


# -- text blocks -------------------------------------------------------------

def truncate_desc(text: Column | str, limit: int = 300) -> Column:
    text = as_col(text)
    cut = F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def strip_site_suffix(title: Column | str, site: str = "Snowflake") -> Column:
    return strip(F.regexp_replace(as_col(title), rf"(?U)\s*[|\-–]\s*{site}.*$", ""))


def before_pipe(title: Column | str) -> Column:
    return strip(F.substring_index(as_col(title), "|", 1))


def yaml_quote(text: Column | str) -> Column:
    return F.replace(as_col(text), F.lit('"'), F.lit('\\"'))


def strip_nav_footer(text: Column | str) -> Column:
    pattern = r"\n\n---\n\n" + V.NAV_MARKER + r"\n[^\n]*\n?$"
    return F.rtrim(F.regexp_replace(as_col(text), pattern, ""), F.lit("\n"))


def strip_series_nav(text: Column | str) -> Column:
    return F.rtrim(F.substring_index(as_col(text), V.SERIES_MARKER, 1), F.lit(V.WHITESPACE))


def strip_front_matter(text: Column | str) -> Column:
    def cut(whole: Column) -> Column:
        return let(F.split(whole, "---", 3), lambda parts: F.when(
            whole.startswith("---") & (F.size(parts) >= 3), strip(F.get(parts, F.lit(2)))
        ).otherwise(whole))

    return let(as_col(text), cut)


def drop_first_heading(text: Column | str) -> Column:
    """Remove the first line that begins with ``#``; positions, not a backtracking regex."""

    def cut(body: Column) -> Column:
        # A line break in front gives every line, the first one too, the same shape.
        def around(at: Column) -> Column:
            rest = F.substr(body, at + 1)
            end = F.instr(rest, "\n")
            after = F.when(end > 0, F.substr(rest, end)).otherwise("")
            return F.when(at > 0, F.concat(F.substr(body, F.lit(1), at - 1), after)).otherwise(body)

        return let(F.instr(body, "\n#"), around)

    return strip(let(F.concat(F.lit("\n"), as_col(text)), cut))


def collapse_blank_lines(text: Column | str) -> Column:
    def collapse(raw: Column) -> Column:
        return F.when(raw.contains("\n\n\n"), F.regexp_replace(raw, r"\n{3,}", "\n\n")).otherwise(raw)

    return strip(let(as_col(text), collapse))


def word_count(text: Column | str) -> Column:
    return F.regexp_count(as_col(text), F.lit(r"(?U)\S+")).cast("long")


def char_count(text: Column | str) -> Column:
    return F.length(as_col(text)).cast("long")


def novel_status(page_text: Column | str) -> Column:
    """Whole words only, so that "incomplete" does not read as finished."""
    text = F.lower(as_col(page_text))
    return (
        F.when(text.rlike(r"\bcompleted?\b"), "completed")
        .when(text.contains("hiatus"), "hiatus")
        .otherwise("ongoing")
    )


def novel_status_from_meta(html: Column | str) -> Column:
    description = F.regexp_extract(
        as_col(html), r'<meta name="description"[^>]*content="([^"]*)"', 1
    )
    return F.when(F.lower(description).contains("complet"), "completed").otherwise("ongoing")


def first_heading(text: Column | str) -> Column:
    return strip(extract(text, r"(?m)^[ \t]*# [ \t]*(\S.*)$"))


def title_from_slug(slug: Column | str) -> Column:
    return F.initcap(F.translate(F.substring_index(as_col(slug), "/", -1), "-", " "))


def keyword_list(keywords: Column | str) -> Column:
    parts = F.transform(F.split(as_col(keywords), ","), strip)
    return F.filter(parts, lambda x: x != "")


def parse_tags(tags: Column | str) -> Column:
    """JSON list of tags; anything else gives an empty list."""
    return F.coalesce(
        F.from_json(as_col(tags), "array<string>"), F.array().cast("array<string>")
    )


def merge_tags(base: Column | str, extra: Column | str) -> Column:
    """Base tags, then every extra tag that is not a base tag; repeats among extras stay."""
    base, extra = as_col(base), as_col(extra)
    return F.concat(base, F.filter(extra, lambda x: ~F.array_contains(base, x)))


def append_absent(base: Column | str, extra: Column | str) -> Column:
    """Base list, then every extra entry not seen before (categories, then tags)."""
    start = F.coalesce(as_col(base), F.array().cast("array<string>"))
    return F.reduce(
        F.coalesce(as_col(extra), F.array().cast("array<string>")),
        start,
        lambda acc, x: F.when(F.array_contains(acc, x), acc).otherwise(F.array_append(acc, x)),
    )


# -- numbers -----------------------------------------------------------------

def new_items(available: Column | str, local: Column | str) -> Column:
    return F.greatest(F.lit(0), as_col(available) - as_col(local))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, one decimal; null where there is no whole."""
    return F.when(whole > 0, F.round(part * F.lit(100.0).cast("double") / whole, 1))
