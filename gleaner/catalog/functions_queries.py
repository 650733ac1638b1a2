"""Scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner import values as V
from gleaner.catalog.inputs import (
    CHAPTERS_SQL, LEDGER_SQL, chapters, ledger, post_urls, post_urls_sql, table,
)
from gleaner.catalog.registry import query
from gleaner.functions import notes as N
from gleaner.functions import text as T
from gleaner.functions import urls as U

_NAME_SQL = r"""names AS (SELECT p_partkey, '  ' || p_name || ': "' || p_brand || '" <it''s>' || chr(9) || ' /' || p_type || '? ' || chr(10) AS name FROM part)"""
_SAFE_SQL = r"""trim(regexp_replace(regexp_replace(name, '[<>:"/\\|?*]', '', 'g'), '\s+', ' ', 'g'))"""


def _names(spark, d):
    """A part's name with the characters a file name must not hold and uneven white space."""
    name = F.concat_ws(
        "", F.lit("  "), "p_name", F.lit(': "'), "p_brand", F.lit("\" <it's>\t /"), "p_type", F.lit("? \n"))
    return table(spark, d, "part").select("p_partkey", name.alias("name"))


@query("f01_sanitize_filename", f"WITH {_NAME_SQL} SELECT p_partkey, {_SAFE_SQL} AS safe, left({_SAFE_SQL}, 20) AS safe20 FROM names")
def f01(spark, d):
    return _names(spark, d).select(
        "p_partkey", T.sanitize_filename("name").alias("safe"), T.sanitize_filename("name", 20).alias("safe20"))


@query("f02_folder_key", rf"""WITH {_NAME_SQL} SELECT p_partkey,
 lower(regexp_replace(regexp_replace(name, '[<>:"/\\|?*]', '', 'g'), '\s+', '_', 'g')) AS folder FROM names""")
def f02(spark, d):
    return _names(spark, d).select("p_partkey", T.folder_key("name").alias("folder"))


@query("f03_title_case", rf"""WITH {_NAME_SQL} SELECT p_partkey,
 array_to_string(list_transform(string_split({_SAFE_SQL}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS folder FROM names""")
def f03(spark, d):
    return _names(spark, d).select("p_partkey", T.folder_name("name").alias("folder"))


@query("f04_kebab_case", rf"""WITH {_NAME_SQL} SELECT p_partkey,
 lower(regexp_replace(regexp_replace(name, '[<>:"/\\|?*'']', '', 'g'), '\s+', '-', 'g')) AS tag FROM names""")
def f04(spark, d):
    return _names(spark, d).select("p_partkey", T.kebab_case("name").alias("tag"))


@query("f05_chapter_name", f"""WITH {CHAPTERS_SQL} SELECT novel_id, num,
 printf('%04d - The Story Of %d.md', num, novel_id) AS file, printf('The_Story_Of_%d_Index', novel_id) AS index_name,
 printf('Chapter %03d - Part %d.md', num, num) AS titled FROM chapters""")
def f05(spark, d):
    folder = T.folder_name("name")
    return chapters(spark, d).select(
        "novel_id", "num", T.chapter_file(folder, "num").alias("file"), T.index_link(folder).alias("index_name"),
        T.titled_chapter_file("num", F.concat(F.lit("Part "), F.col("num").cast("string"))).alias("titled"))


_SLUG_DATED_SQL = rf"""CASE WHEN p = '' OR p LIKE 'page/%' THEN NULL
 WHEN regexp_matches(p, '^\d{{4}}/\d\d/\d\d/') THEN regexp_replace(p, '^(\d{{4}})/(\d\d)/(\d\d)/(.+?)(?:\.html)?$', '\1-\2-\3-\4')
 WHEN contains(p, '/') THEN NULL ELSE p END"""
_BLOG_SQL = f"{post_urls_sql(V.BLOG_PREFIX)}, paths AS (SELECT page_id, url, trim(replace(url, '{V.BLOG_PREFIX}', ''), '/') AS p FROM posts)"


@query("f06_slug_dated", f"WITH {_BLOG_SQL} SELECT page_id, url, {_SLUG_DATED_SQL} AS slug FROM paths")
def f06(spark, d):
    return post_urls(spark, d, V.BLOG_PREFIX).select("page_id", "url", U.slug_dated("url").alias("slug"))


_SECOND = V.SECOND_BLOG_PREFIXES[1]


@query("f07_slug_dashes", f"""WITH {post_urls_sql(_SECOND)} SELECT page_id,
 nullif(replace(trim(replace(url, '{_SECOND}', ''), '/'), '/', '-'), '') AS slug FROM posts""")
def f07(spark, d):
    return post_urls(spark, d, _SECOND).select("page_id", U.slug_dashes("url").alias("slug"))


_PATH_SQL = r"regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query("f08_slug_last_segment", rf"""SELECT page_id,
 nullif(split_part(trim({_PATH_SQL}, '/'), '/', -1), '') AS slug,
 nullif(regexp_replace(split_part(trim({_PATH_SQL}, '/'), '/', -1), '\.html$', ''), '') AS page_name FROM pages""")
def f08(spark, d):
    return table(spark, d, "pages").select(
        "page_id", U.slug_last_segment("url").alias("slug"), U.slug_page_name("url").alias("page_name"))


@query("f09_slug_path", rf"""SELECT page_id, coalesce(nullif(trim({_PATH_SQL}, '/'), ''), 'index') AS slug,
 coalesce(nullif(regexp_replace(trim({_PATH_SQL}, '/'), '\.html$', ''), ''), 'index') AS bare FROM pages""")
def f09(spark, d):
    return table(spark, d, "pages").select(
        "page_id", U.slug_path("url").alias("slug"), U.slug_path("url", drop_html=True).alias("bare"))


@query("f10_parent_path", rf"""SELECT page_id, array_to_string(string_split(trim({_PATH_SQL}, '/'), '/')[:-2], '/') AS parent FROM pages""")
def f10(spark, d):
    return table(spark, d, "pages").select("page_id", U.parent_path(U.slug_path("url")).alias("parent"))


def _novel_urls(spark, d):
    n = F.col("page_id").cast("string")
    kind = F.col("page_id") % 6
    return table(spark, d, "pages").select(
        "page_id",
        F.when(kind == 0, F.concat(F.lit("https://lightnovelstranslations.com/novel/story-"), n, F.lit("/?tab=x")))
        .when(kind == 1, F.concat(F.lit("https://freewebnovel.com/story-"), n, F.lit(".html")))
        .when(kind == 2, F.concat(F.lit("https://FreeWebNovel.com/story-"), n, F.lit("/chapter-3.html")))
        .when(kind == 3, F.concat(F.lit("https://novelbin.com/b/story-"), n, F.lit("/one")))
        .when(kind == 4, F.concat(F.lit("https://www.webnovel.com/book/story_"), n))
        .otherwise(F.col("url")).alias("url"))


_NOVEL_URL_SQL = """novel_urls AS (SELECT page_id, page_id AS n, CASE page_id % 6
 WHEN 0 THEN 'https://lightnovelstranslations.com/novel/story-' || page_id || '/?tab=x'
 WHEN 1 THEN 'https://freewebnovel.com/story-' || page_id || '.html'
 WHEN 2 THEN 'https://FreeWebNovel.com/story-' || page_id || '/chapter-3.html'
 WHEN 3 THEN 'https://novelbin.com/b/story-' || page_id || '/one'
 WHEN 4 THEN 'https://www.webnovel.com/book/story_' || page_id ELSE url END AS url FROM pages)"""


@query("f11_novel_slug", f"""WITH {_NOVEL_URL_SQL} SELECT page_id, CASE WHEN page_id % 6 < 4 THEN 'story-' || page_id
 WHEN page_id % 6 = 4 THEN '' || page_id END AS slug FROM novel_urls""")
def f11(spark, d):
    return _novel_urls(spark, d).select("page_id", U.novel_slug("url", U.site_of("url")).alias("slug"))


@query("f12_site_of", f"""WITH {_NOVEL_URL_SQL} SELECT page_id, CASE WHEN url ILIKE '%lightnovelstranslations.com%' THEN 'lightnovelstranslations.com'
 WHEN url ILIKE '%freewebnovel.com%' THEN 'freewebnovel.com' WHEN url ILIKE '%novelbin.com%' THEN 'novelbin.com'
 WHEN url ILIKE '%webnovel.com%' THEN 'webnovel.com' END AS site FROM novel_urls""")
def f12(spark, d):
    return _novel_urls(spark, d).select("page_id", U.site_of("url").alias("site"))


@query("f13_json_endpoint_candidates", rf"""WITH {_BLOG_SQL}, both_urls AS (SELECT page_id, regexp_matches(p, '^\d{{4}}/\d\d/\d\d/.+\.html$') AS legacy,
 '{V.BLOG_BASE}{V.BLOG_NEW_DATA}' || p || '{V.BLOG_DATA_FILE}' AS new_url, '{V.BLOG_BASE}{V.BLOG_LEGACY_DATA}' || p || '{V.BLOG_DATA_FILE}' AS old_url FROM paths)
 SELECT page_id, CASE WHEN legacy THEN old_url ELSE new_url END AS first_url, CASE WHEN legacy THEN new_url ELSE old_url END AS second_url FROM both_urls""")
def f13(spark, d):
    both = U.json_endpoint_candidates("url")
    return post_urls(spark, d, V.BLOG_PREFIX).select("page_id", both[0].alias("first_url"), both[1].alias("second_url"))


@query("f14_post_id", """SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN left(md5(url), 12) END AS post_id FROM pages""")
def f14(spark, d):
    tail = F.when(F.col("page_id") % 3 == 0, "Plain").otherwise(F.left(F.md5("url"), F.lit(12)))
    url = F.concat(F.lit("https://medium.com/@someone/a-title-"), tail, F.lit("?source=rss"))
    return table(spark, d, "pages").select("page_id", U.post_id(url).alias("post_id"))


def _video_urls(spark, d):
    n, kind = F.col("page_id").cast("string"), F.col("page_id") % 6
    return table(spark, d, "pages").select(
        "page_id",
        F.when(kind == 0, F.concat(F.lit("https://youtu.be/v"), n, F.lit("?t=4")))
        .when(kind == 1, F.concat(F.lit("https://www.youtube.com/watch?list=a&v=v"), n, F.lit("&t=1")))
        .when(kind == 2, F.concat(F.lit("https://m.youtube.com/shorts/v"), n, F.lit("/x")))
        .when(kind == 3, F.concat(F.lit("https://youtube.com/embed/v"), n))
        .when(kind == 4, F.lit("https://youtube.com/watch?list=a"))
        .otherwise(F.col("url")).alias("url"))


@query("f15_video_id", "SELECT page_id, CASE WHEN page_id % 6 < 4 THEN 'v' || page_id END AS video_id FROM pages")
def f15(spark, d):
    return _video_urls(spark, d).select("page_id", U.video_id("url").alias("video_id"))


@query("f16_username_of", f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'user' || page_id ELSE '{V.IMPORT_USER}' END AS username FROM pages")
def f16(spark, d):
    n = F.col("page_id").cast("string")
    url = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://medium.com/@user"), n, F.lit("/a-post"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", U.username_of(url).alias("username"))


@query("f17_chapter_no", f"""WITH {CHAPTERS_SQL} SELECT novel_id, num, CASE WHEN role = 'user' THEN num WHEN role = 'assistant' THEN num + 100 END AS found FROM chapters""")
def f17(spark, d):
    n = F.col("num").cast("string")
    text = F.when(F.col("role") == "user", F.concat(F.lit("read CHAPTER "), n)).otherwise("Prologue")
    href = F.when(F.col("role") == "assistant", F.concat(F.lit("/novel/x/chapter-"), (F.col("num") + 100).cast("string"))).otherwise("/novel/x/start")
    return chapters(spark, d).select("novel_id", "num", T.chapter_no(text, href).alias("found"))


@query("f18_chapter_no_from_page", f"""WITH {CHAPTERS_SQL} SELECT novel_id, num, CASE WHEN role = 'system' THEN NULL ELSE num END AS found FROM chapters""")
def f18(spark, d):
    n = F.col("num").cast("string")
    title = F.when(F.col("role") == "user", F.concat(F.lit("Story - Chapter "), n, F.lit(" | Site"))).otherwise("Story | Site")
    first = F.when(F.col("role") == "assistant", F.concat(F.lit("Ch. "), n, F.lit(" begins"))).otherwise("none")
    return chapters(spark, d).select("novel_id", "num", T.chapter_no_from_page(title, first).alias("found"))


@query("f19_chapter_no_from_file", f"""WITH {CHAPTERS_SQL} SELECT novel_id, num, CASE WHEN num % 4 = 3 THEN NULL ELSE num END AS found FROM chapters""")
def f19(spark, d):
    num, n = F.col("num"), F.col("num").cast("string")
    name = (
        F.when(num % 4 == 0, F.concat(F.lit("Chapter_000"), n, F.lit("_x.md")))
        .when(num % 4 == 1, F.concat(F.lit("Chapter 00"), n, F.lit(" - x.md")))
        .when(num % 4 == 2, F.concat(F.lit("000"), n, F.lit(" - Story.md")))
        .otherwise(F.concat(F.lit("Story "), n, F.lit(".md"))))
    return chapters(spark, d).select("novel_id", "num", T.chapter_no_from_file(name).alias("found"))


@query("f20_chapter_title", f"""WITH {CHAPTERS_SQL} SELECT novel_id, num, CASE role WHEN 'user' THEN 'Chapter ' || num || ': Dawn'
 WHEN 'assistant' THEN 'Chapter ' || num ELSE 'Chapter ' || num END AS title FROM chapters""")
def f20(spark, d):
    n = F.col("num").cast("string")
    page = (
        F.when(F.col("role") == "user", F.concat("name", F.lit(" - Chapter "), n, F.lit(": Dawn | Site")))
        .when(F.col("role") == "assistant", F.concat(T.title_case("name"), F.lit(" - Chapter "), n, F.lit(" | Site")))
        .otherwise("Front page"))
    return chapters(spark, d).select("novel_id", "num", T.chapter_title(page, "name", "num").alias("title"))


@query("f21_iso_date_prefix", """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def f21(spark, d):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("on "), stamp)).otherwise(stamp)
    return table(spark, d, "orders").select("o_orderkey", T.iso_date_prefix(text).cast("string").alias("day"))


@query("f22_rfc2822_date", """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def f22(spark, d):
    rfc = F.concat(F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" -0700"))
    text = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderstatus") == "P", "soon").otherwise(rfc)
    return table(spark, d, "orders").select("o_orderkey", T.rfc2822_date(text).cast("string").alias("day"))


@query("f23_truncate_desc", "SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 297) || '...' ELSE text END AS description FROM documents")
def f23(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate_desc("text").alias("description"))


@query("f24_strip_site_suffix", """SELECT p_partkey, p_name || CASE WHEN p_partkey % 4 = 3 THEN ' - other' ELSE '' END AS title, p_name AS before_pipe FROM part""")
def f24(spark, d):
    kind = F.col("p_partkey") % 4
    tail = F.when(kind == 0, " | Snowflake").when(kind == 1, " - Snowflake Blog").when(kind == 2, " – Snowflake Inc.").otherwise(" - other")
    return table(spark, d, "part").select(
        "p_partkey", T.strip_site_suffix(F.concat("p_name", tail)).alias("title"),
        T.before_pipe(F.concat("p_name", F.lit(" | Docs | More"))).alias("before_pipe"))


@query("f25_yaml_quote", r"""SELECT p_partkey, replace('"' || p_name || '" ' || p_brand, '"', '\"') AS quoted FROM part""")
def f25(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", T.yaml_quote(F.concat(F.lit('"'), "p_name", F.lit('" '), "p_brand")).alias("quoted"))


@query("f26_front_matter", r"""SELECT doc_id,
 '---' || chr(10) || 'title: "Note ' || doc_id || ' \"' || lang || '\""' || chr(10) || 'source: "https://example.com/' || doc_id || '"' || chr(10)
 || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'author:' || chr(10) || '  - "[[' || lang || ']]"' || chr(10)
    ELSE 'author:' || chr(10) || '  - "[[' || lang || ']]"' || chr(10) || '  - "[[' || source || ']]"' || chr(10) END
 || CASE WHEN doc_id % 2 = 0 THEN 'published: 2024-02-03' || chr(10) ELSE '' END
 || 'created: 2024-05-06' || chr(10)
 || CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'description: "' || replace(text, '"', '\"') || '"' || chr(10) END
 || 'tags:' || chr(10) || '  - "clippings"' || chr(10) || '  - "' || source || '"' || chr(10) || '---' AS head FROM documents""")
def f26(spark, d):
    n = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 3
    none = F.array().cast("array<string>")
    return table(spark, d, "documents").select("doc_id", N.front_matter(
        title=F.concat(F.lit("Note "), n, F.lit(' "'), "lang", F.lit('"')),
        url=F.concat(F.lit("https://example.com/"), n),
        created=F.lit("2024-05-06"),
        tags=F.array(F.lit("clippings"), "source"),
        authors=F.when(kind == 0, none).when(kind == 1, F.array("lang")).otherwise(F.array("lang", "source")),
        published=F.when(F.col("doc_id") % 2 == 0, F.lit("2024-02-03")),
        description=F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text")),
    ).alias("head"))


_BOOK_SQL = "'---' || chr(10) || 'tags:' || chr(10) || '  - book/novel' || chr(10) || '  - the-story-of-' || novel_id || chr(10) || '---' || repeat(chr(10), 2) || '# The Story Of ' || novel_id || repeat(chr(10), 2)"


@query("f27_chapter_note", f"""WITH {CHAPTERS_SQL} SELECT novel_id, num, {_BOOK_SQL} || '**Novel:** The Story Of ' || novel_id || repeat(chr(10), 2)
 || '**Chapter:** ' || num || repeat(chr(10), 2) || '---' || repeat(chr(10), 2) || text || chr(10) AS note,
 '# Chapter ' || num || repeat(chr(10), 2) || text || chr(10) AS plain FROM chapters""")
def f27(spark, d):
    return chapters(spark, d).select(
        "novel_id", "num",
        N.chapter_note(T.folder_name("name"), T.kebab_case("name"), "num", "text").alias("note"),
        N.plain_chapter_note(F.concat(F.lit("Chapter "), F.col("num").cast("string")), "text").alias("plain"))


@query("f28_strip_nav_footer", f"""WITH {CHAPTERS_SQL} SELECT novel_id, num, rtrim(text, chr(10)) AS body, rtrim(text, chr(10) || ' ') AS series_body FROM chapters""")
def f28(spark, d):
    folder = T.folder_name("name")
    once = N.with_nav("text", N.nav_footer(folder, F.lit(None).cast("long"), F.col("num") + 1))
    block = N.series_nav(F.lit(None).cast("string"), F.lit("Next"))
    return chapters(spark, d).select(
        "novel_id", "num", T.strip_nav_footer(once).alias("body"),
        T.strip_series_nav(N.with_series_nav("text", block)).alias("series_body"))


@query("f29_strip_front_matter", f"""WITH {CHAPTERS_SQL} SELECT novel_id, num, trim(text, chr(10) || ' ') AS body, trim('intro' || chr(10) || text, chr(10) || ' ') AS headless FROM chapters""")
def f29(spark, d):
    whole = F.concat(F.lit("---\ntags:\n  - x\n---\n\n"), "text", F.lit("\n"))
    headed = F.concat(F.lit("intro\n# A heading\n"), "text")
    return chapters(spark, d).select(
        "novel_id", "num", T.strip_front_matter(whole).alias("body"), T.drop_first_heading(headed).alias("headless"))


@query("f30_collapse_blank_lines", r"""SELECT doc_id, trim(regexp_replace(replace(text, chr(10), repeat(chr(10), 4)), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ') AS body FROM documents""")
def f30(spark, d):
    wide = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n\n\n"))
    return table(spark, d, "documents").select("doc_id", T.collapse_blank_lines(wide).alias("body"))


@query("f31_word_and_char_count", r"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS BIGINT) AS words, length(text) AS chars FROM documents""")
def f31(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count("text").alias("words"), T.char_count("text").alias("chars"))


def _series_title():
    """Titles of every series form, plus one of no series and one with an unknown roman number."""
    key, size = F.col("p_partkey") % 7, F.col("p_size")
    romans = F.array(*[F.lit(r) for r in V.ROMAN])
    roman = F.element_at(romans, (size % 10 + 1).cast("int"))
    name, n = F.col("p_name"), size.cast("string")
    return (
        F.when(key == 0, F.concat(name, F.lit(": Part "), roman, F.lit(" of X")))
        .when(key == 1, F.concat(name, F.lit(" - Part "), roman))
        .when(key == 2, F.concat(name, F.lit(" — part "), n, F.lit(" of 60")))
        .when(key == 3, F.concat(name, F.lit(" (Part "), n, F.lit(")")))
        .when(key == 4, F.concat(name, F.lit(" Part "), roman, F.lit(" of ten")))
        .when(key == 5, F.concat(name, F.lit(" - Part XV")))
        .otherwise(name))


_ROMAN_SQL = "['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X']"
SERIES_SQL = f"""titled AS (SELECT p_partkey, p_name AS base_in, k, p_size, CASE k
   WHEN 0 THEN p_name || ': Part ' || roman || ' of X' WHEN 1 THEN p_name || ' - Part ' || roman
   WHEN 2 THEN p_name || ' — part ' || p_size || ' of 60' WHEN 3 THEN p_name || ' (Part ' || p_size || ')'
   WHEN 4 THEN p_name || ' Part ' || roman || ' of ten' WHEN 5 THEN p_name || ' - Part XV' ELSE p_name END AS title
 FROM (SELECT *, p_partkey % 7 AS k, {_ROMAN_SQL}[p_size % 10 + 1] AS roman FROM part)),
series AS (SELECT p_partkey, title, CASE WHEN k < 5 THEN base_in END AS base,
   CAST(CASE WHEN k IN (0, 1, 4) THEN p_size % 10 + 1 WHEN k IN (2, 3) THEN p_size END AS BIGINT) AS part FROM titled)"""


def series_titles(spark, d):
    return table(spark, d, "part").select("p_partkey", _series_title().alias("title"))


@query("f32_series_part", f"WITH {SERIES_SQL} SELECT p_partkey, base, part FROM series")
def f32(spark, d):
    found = T.series_part("title")
    return series_titles(spark, d).select("p_partkey", found["base"].alias("base"), found["part"].cast("long").alias("part"))


@query("f33_novel_status", """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'completed' WHEN doc_id % 4 = 1 THEN 'hiatus' ELSE 'ongoing' END AS status,
 CASE WHEN doc_id % 4 = 0 THEN 'completed' ELSE 'ongoing' END AS meta_status FROM documents""")
def f33(spark, d):
    kind = F.col("doc_id") % 4
    tail = F.when(kind == 0, " Status: Completed.").when(kind == 1, " On HIATUS").when(kind == 2, " incomplete").otherwise("")
    html = F.concat(F.lit('<meta name="description" content="'), F.when(kind == 0, "A complete tale").otherwise("A tale"), F.lit('">'))
    return table(spark, d, "documents").select(
        "doc_id", T.novel_status(F.concat("text", tail)).alias("status"), T.novel_status_from_meta(html).alias("meta_status"))


@query("f34_cloud_tag", """SELECT doc_id, CASE lang WHEN 'en' THEN 'aws' WHEN 'de' THEN 'gcp' WHEN 'fr' THEN 'azure' END AS cloud FROM documents""")
def f34(spark, d):
    lang = F.col("lang")
    first = F.when(lang == "en", "AWS").when(lang == "de", "gcp").when(lang == "fr", "azure").otherwise(lang)
    return table(spark, d, "documents").select("doc_id", U.cloud_tag(F.concat(first, F.lit("/en/page"))).alias("cloud"))


@query("f35_page_title", r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Head of ' || doc_id ELSE 'My Page ' || doc_id END AS title FROM documents""")
def f35(spark, d):
    n = F.col("doc_id").cast("string")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("## Not this\n  # Head of "), n, F.lit(" \n"), "text")).otherwise(F.regexp_replace("text", "(?m)^#", ""))
    slug = F.concat(F.lit("en/my-page-"), n)
    return table(spark, d, "documents").select("doc_id", F.coalesce(T.first_heading(text), T.title_from_slug(slug)).alias("title"))


@query("f36_output_path", rf"""SELECT page_id,
 CASE WHEN page_id % 2 = 0 THEN 'Databricks Glossary/' ELSE 'Databricks/' END || 'Page ' || page_id || ' a.md' AS blog,
 CASE WHEN page_id % 3 = 0 THEN 'YouTube/' ELSE 'Raindrop/' END || 'Page ' || page_id || ' a.md' AS bookmark,
 'Docs/' || regexp_replace(trim({_PATH_SQL}, '/'), '\.html$', '') || '.md' AS doc FROM pages""")
def f36(spark, d):
    title = F.concat(F.lit("Page: "), F.col("page_id").cast("string"), F.lit(" a?"))
    return table(spark, d, "pages").select(
        "page_id",
        N.blog_path(title, F.lit("s"), F.when(F.col("page_id") % 2 == 0, "glossary").otherwise("blog")).alias("blog"),
        N.bookmark_path(title, F.when(F.col("page_id") % 3 == 0, "youtube").otherwise("web")).alias("bookmark"),
        N.doc_path(F.lit("Docs"), U.slug_path("url", drop_html=True)).alias("doc"))


@query("f37_nullif_blank", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'none' ELSE lang END AS lang FROM documents")
def f37(spark, d):
    blank = F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", F.coalesce(T.nullif_blank(blank), F.lit("none")).alias("lang"))


@query("f38_keyword_list", "SELECT doc_id, lang || '|' || source || '|last' AS keywords FROM documents")
def f38(spark, d):
    words = F.concat("lang", F.lit(" ,, "), "source", F.lit(" , last,"))
    return table(spark, d, "documents").select("doc_id", F.array_join(T.keyword_list(words), "|").alias("keywords"))


@query("f39_parse_tags", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang || '|' || source END AS tags FROM documents")
def f39(spark, d):
    tags = F.when(F.col("doc_id") % 3 == 0, "not json").otherwise(F.to_json(F.array("lang", "source")))
    return table(spark, d, "documents").select("doc_id", F.array_join(T.parse_tags(tags), "|").alias("tags"))


@query("f40_chapter_url", f"""WITH {CHAPTERS_SQL} SELECT novel_id, num, 'https://freewebnovel.com/novel/' ||
 CASE WHEN novel_id % 2 = 0 THEN 'my-dragon-system' ELSE 'the-story-of-' || novel_id END || '/chapter-' || num AS url FROM chapters""")
def f40(spark, d):
    name = F.when(F.col("novel_id") % 2 == 0, " My Dragon System ").otherwise(F.col("name"))
    return chapters(spark, d).select("novel_id", "num", U.chapter_url(name, "num").alias("url"))


@query("f41_numbers", """SELECT o_orderkey, greatest(0, o_custkey - o_orderkey) AS new_items, round(least(o_custkey, o_orderkey) * CAST(100.0 AS DOUBLE) / nullif(o_orderkey, 0), 1) AS pct,
 abs(o_custkey - o_orderkey) AS distance, printf('%04d', o_orderkey) AS padded FROM orders""")
def f41(spark, d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        "o_orderkey", T.new_items(cust, key).alias("new_items"), T.percent(F.least(cust, key), key).alias("pct"),
        F.abs(cust - key).alias("distance"), F.format_string("%04d", key).alias("padded"))


@query("f42_time_stamps", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def f42(spark, d):
    return table(spark, d, "events").select("event_id", T.day("ts").alias("day"))


@query("f43_json_access", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.a.b'), '') AS missing FROM events")
def f43(spark, d):
    fields = F.from_json("props", "struct<k:bigint,a:struct<b:string>>")
    return table(spark, d, "events").select(
        "event_id", fields["k"].alias("k"), F.coalesce(fields["a"]["b"], F.lit("")).alias("missing"))
