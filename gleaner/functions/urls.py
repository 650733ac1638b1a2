"""URL functions and URL predicates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import values as V
from gleaner.functions.text import as_col, extract, nullif_blank

_URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)"


def _strip_slash(text: Column) -> Column:
    return F.btrim(text, F.lit("/"))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def host(url: Column | str) -> Column:
    """Lower-case host without user or port ('' for a text that is no URL)."""
    authority = F.regexp_extract(as_col(url), _URL, 1)
    return F.lower(F.regexp_replace(authority, r"^.*@|:\d*$", ""))


def path(url: Column | str) -> Column:
    return F.regexp_extract(as_col(url), _URL, 2)


# -- predicates ----------------------------------------------------------------

def is_post_url(url: Column | str, prefix: str = V.BLOG_PREFIX) -> Column:
    return as_col(url).startswith(prefix) & slug_dated(url, prefix).isNotNull()


def is_blog_url(url: Column | str, prefixes: list[str] = V.SECOND_BLOG_PREFIXES) -> Column:
    """A post below one of the prefixes; the first prefix that fits decides."""
    url = as_col(url)
    listing = rf"^({'|'.join(map(re.escape, V.SECOND_LISTING_SEGMENTS))})(/|$)"
    result = F.lit(False)
    for prefix in reversed(prefixes):
        rest = _strip_slash(F.substr(url, F.lit(len(prefix) + 1)))
        keep = (rest != "") & ~rest.rlike(listing) & ~rest.rlike(r"^\d+$")
        result = F.when(url.startswith(prefix), keep).otherwise(result)
    return result


def is_localized(url: Column | str) -> Column:
    first = F.lower(F.substring_index(_strip_slash(path(url)), "/", 1))
    return first.rlike(r"^[a-z]{2}(_[a-z]{2})?$")


def english_glossary(url: Column | str, prefix: str = V.GLOSSARY_PREFIX) -> Column:
    url = as_col(url)
    slug = _strip_slash(F.replace(url, F.lit(prefix), F.lit("")))
    foreign = url.rlike(r"databricks\.com/[a-z]{2}/glossary/")
    return url.startswith(prefix) & ~foreign & (slug != "") & ~slug.contains("/")


def match_any_path(url: Column | str, paths: list[str]) -> Column:
    """Case-insensitive substring test against a configured list; no list keeps all."""
    if not paths:
        return F.lit(True)
    lowered = F.lower(as_col(url))
    return _any([lowered.contains(p.strip("/").lower()) for p in paths])


def url_family(url: Column | str, domains: list[str] = V.MEDIUM_DOMAINS) -> Column:
    name = host(url)
    medium = (name == "medium.com") | name.endswith(".medium.com") | name.isin(domains)
    return (
        F.when(medium, "medium").when(name.isin(V.YOUTUBE_HOSTS), "youtube").otherwise("web")
    )


def is_short_link(url: Column | str) -> Column:
    return host(url).isin(V.SHORT_LINK_HOSTS)


# -- slugs ---------------------------------------------------------------------

def slug_dated(url: Column | str, prefix: str = V.BLOG_PREFIX) -> Column:
    """Slug of a post: dated legacy path, or one path segment; listings give null."""
    rest = _strip_slash(F.replace(as_col(url), F.lit(prefix), F.lit("")))
    dated = r"^(\d{4})/(\d{2})/(\d{2})/(.+?)(?:\.html)?$"
    listing = _any([rest.startswith(s + "/") for s in V.LISTING_SEGMENTS])
    return (
        F.when((rest == "") | listing, F.lit(None))
        .when(rest.rlike(dated), F.regexp_replace(rest, dated, "$1-$2-$3-$4"))
        .when(~rest.contains("/"), rest)
    )


def slug_dashes(url: Column | str, prefixes: list[str] = V.SECOND_BLOG_PREFIXES) -> Column:
    url = as_col(url)
    result = F.lit(None).cast("string")
    for prefix in reversed(prefixes):
        rest = F.translate(_strip_slash(F.substr(url, F.lit(len(prefix) + 1))), "/", "-")
        result = F.when(url.startswith(prefix), nullif_blank(rest)).otherwise(result)
    return result


def slug_last_segment(url: Column | str) -> Column:
    """Last path segment that is no ``@user``."""
    parts = F.filter(F.split(path(url), "/"), lambda p: (p != "") & ~p.startswith("@"))
    return F.try_element_at(parts, F.lit(-1))


def slug_page_name(url: Column | str) -> Column:
    """Last path segment without ``.html``."""
    last = F.substring_index(_strip_slash(path(url)), "/", -1)
    return nullif_blank(F.regexp_replace(last, r"\.html$", ""))


def slug_path(url: Column | str, drop_html: bool = False) -> Column:
    rest = _strip_slash(path(url))
    if drop_html:
        rest = F.regexp_replace(rest, r"\.html$", "")
    return F.coalesce(nullif_blank(rest), F.lit("index"))


def slug_below(url: Column | str, base: str) -> Column:
    """Slug relative to a base URL, trailing slash off."""
    return F.rtrim(F.replace(as_col(url), F.lit(base + "/"), F.lit("")), F.lit("/"))


def parent_path(slug: Column | str) -> Column:
    slug = as_col(slug)
    return F.when(slug.contains("/"), F.regexp_replace(slug, r"/[^/]*$", "")).otherwise("")


def novel_slug(url: Column | str, site: Column | str) -> Column:
    url, site = as_col(url), as_col(site)
    trimmed = F.rtrim(url, F.lit("/"))
    last = F.replace(F.substring_index(trimmed, "/", -1), F.lit(".html"), F.lit(""))
    previous = F.substring_index(F.substring_index(trimmed, "/", -2), "/", 1)
    return (
        F.when(site.contains(V.NOVEL_SITES[0]), extract(url, r"/novel/([^/?]+)"))
        .when(
            site.contains(V.NOVEL_SITES[1]),
            F.when(last.startswith("chapter-"), previous).otherwise(last),
        )
        .when(site.contains(V.NOVEL_SITES[2]), extract(url, r"/b/([^/]+)"))
        .when(site.contains(V.NOVEL_SITES[3]), extract(url, r"_(\d+)(?:/|$)"))
    )


def site_of(url: Column | str, sites: list[str] = V.NOVEL_SITES) -> Column:
    """First registered site whose name occurs in the URL."""
    lowered = F.lower(as_col(url))
    return F.coalesce(*[F.when(lowered.contains(s), F.lit(s)) for s in sites])


def json_endpoint_candidates(url: Column | str, prefix: str = V.BLOG_PREFIX) -> Column:
    """``[primary, fallback]`` data URLs; dated legacy posts swap the two."""
    rest = _strip_slash(F.replace(as_col(url), F.lit(prefix), F.lit("")))
    new = F.concat(F.lit(V.BLOG_BASE + V.BLOG_NEW_DATA), rest, F.lit(V.BLOG_DATA_FILE))
    old = F.concat(F.lit(V.BLOG_BASE + V.BLOG_LEGACY_DATA), rest, F.lit(V.BLOG_DATA_FILE))
    legacy = rest.rlike(r"^\d{4}/\d{2}/\d{2}/.+\.html$")
    return F.when(legacy, F.array(old, new)).otherwise(F.array(new, old))


def post_id(url: Column | str) -> Column:
    last = F.substring_index(_strip_slash(path(url)), "/", -1)
    return extract(last, r"-([0-9a-f]{8,})$")


def video_id(url: Column | str) -> Column:
    where, rest = host(url), path(url)
    query = F.try_url_decode(extract(url, r"[?&]v=([^&#]+)"))
    embedded = _strip_slash(extract(rest, r"^/(?:shorts|embed|v)(/.*)$"))
    return (
        F.when(where == "youtu.be", _strip_slash(rest))
        .when(rest.startswith("/watch"), query)
        .otherwise(F.substring_index(embedded, "/", 1))
    )


def username_of(url: Column | str) -> Column:
    first = F.substring_index(_strip_slash(path(url)), "/", 1)
    return F.when(
        (host(url) == "medium.com") & first.startswith("@"), F.ltrim(first, F.lit("@"))
    ).otherwise(V.IMPORT_USER)


def cloud_tag(slug: Column | str) -> Column:
    """Cloud named by the first slug segment, else null."""
    first = F.lower(F.substring_index(as_col(slug), "/", 1))
    return F.when(first.isin(V.CLOUDS), first)


def chapter_url(name: Column | str, num: Column | str) -> Column:
    """Chapter URL from the name's template, else from the slug rule."""
    key = F.btrim(F.lower(as_col(name)), F.lit(V.WHITESPACE))
    known = F.create_map(*[F.lit(x) for pair in V.NOVEL_URL_TEMPLATES.items() for x in pair])
    default = F.concat(
        F.lit(V.NOVEL_URL_BASE), F.translate(key, " ", "-"), F.lit("/chapter-{chapter}")
    )
    template = F.coalesce(F.try_element_at(known, key), default)
    return F.replace(template, F.lit("{chapter}"), as_col(num).cast("string"))
