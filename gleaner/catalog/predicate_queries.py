"""Selections, predicates, orders, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner import values as V
from gleaner.catalog import inputs as I
from gleaner.catalog.functions_queries import _BLOG_SQL, _PATH_SQL, _SLUG_DATED_SQL
from gleaner.catalog.inputs import CHAPTERS_SQL, LEDGER_SQL, table
from gleaner.catalog.registry import query
from gleaner.functions import text as T
from gleaner.functions import urls as U
from gleaner.operators import joins as J
from gleaner.operators import selection as S
from gleaner.operators.sequences import dedup_first
from gleaner.sources.payloads import typed_payloads


@query("p01_select_items", f"WITH {LEDGER_SQL} SELECT id, slug, status, content_type FROM ledger WHERE status = 'downloaded' AND source = 'site1' AND content_type = 'blog' ORDER BY id LIMIT 100")
def p01(spark, d):
    found = S.select_items(I.ledger(spark, d), status="downloaded", source="site1", content_type="blog", username="", limit=100)
    return found.select("id", "slug", "status", "content_type")


@query("p02_get_item", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_name = 'Customer#000000042'")
def p02(spark, d):
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return S.get_item(people, name="Customer#000000042")


@query("p03_unmoved", f"WITH {LEDGER_SQL} SELECT id, source, file_path FROM ledger WHERE status = 'downloaded' AND NOT in_obsidian AND file_path IS NOT NULL")
def p03(spark, d):
    return S.unmoved(I.ledger(spark, d)).select("id", "source", "file_path")


@query("p04_failed_report", f"""WITH {LEDGER_SQL} SELECT id, coalesce(title, '(untitled)') AS title, url, error_reason AS reason, error_detail AS detail, left(error_html, 200) AS preview FROM ledger WHERE status = 'failed'""")
def p04(spark, d):
    return S.failed_report(I.ledger(spark, d))


@query("p05_is_post_url", f"WITH {_BLOG_SQL} SELECT page_id, {_SLUG_DATED_SQL} IS NOT NULL AS is_post FROM paths")
def p05(spark, d):
    return I.post_urls(spark, d, V.BLOG_PREFIX).select("page_id", U.is_post_url("url").alias("is_post"))


_SECOND = V.SECOND_BLOG_PREFIXES[0]


@query("p06_is_blog_url", rf"""WITH {I.post_urls_sql(_SECOND)}, paths AS (SELECT page_id, trim(replace(url, '{_SECOND}', ''), '/') AS p FROM posts)
 SELECT page_id, p <> '' AND NOT regexp_matches(p, '^(page|category|tag|author|wp-json|feed|archive)(/|$)') AND NOT regexp_matches(p, '^\d+$') AS is_post FROM paths""")
def p06(spark, d):
    return I.post_urls(spark, d, _SECOND).select("page_id", U.is_blog_url("url").alias("is_post"))


@query("p07_is_localized", rf"SELECT page_id, regexp_matches(lower(split_part(trim({_PATH_SQL}, '/'), '/', 1)), '^[a-z]{{2}}(_[a-z]{{2}})?$') AS localized FROM pages")
def p07(spark, d):
    return table(spark, d, "pages").select("page_id", U.is_localized("url").alias("localized"))


_GLOSSARY_SQL = rf"""glossary AS (SELECT page_id, CASE WHEN url LIKE '%/en/%' THEN 'https://www.databricks.com/glossary/term-' || page_id
 WHEN url LIKE '%/fr/%' THEN 'https://www.databricks.com/fr/glossary/term-' || page_id
 WHEN url LIKE '%/es/%' THEN 'https://www.databricks.com/glossary/a/term-' || page_id ELSE url END AS url FROM pages)"""


@query("p08_english_glossary", f"WITH {_GLOSSARY_SQL} SELECT page_id, url FROM glossary WHERE url LIKE 'https://www.databricks.com/glossary/%' AND NOT contains(replace(url, 'https://www.databricks.com/glossary/', ''), '/')")
def p08(spark, d):
    url, n = F.col("url"), F.col("page_id").cast("string")
    rows = table(spark, d, "pages").select(
        "page_id",
        F.when(url.contains("/en/"), F.concat(F.lit("https://www.databricks.com/glossary/term-"), n))
        .when(url.contains("/fr/"), F.concat(F.lit("https://www.databricks.com/fr/glossary/term-"), n))
        .when(url.contains("/es/"), F.concat(F.lit("https://www.databricks.com/glossary/a/term-"), n))
        .otherwise(url).alias("url"))
    return rows.filter(U.english_glossary("url"))


@query("p09_match_any_path", "SELECT page_id, url FROM pages WHERE contains(lower(url), 'example.net/fr') OR contains(lower(url), '.html')")
def p09(spark, d):
    return table(spark, d, "pages").filter(U.match_any_path("url", ["/example.net/FR/", ".HTML"])).select("page_id", "url")


@query("p10_url_family", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'medium' WHEN 1 THEN 'medium' WHEN 2 THEN 'medium' WHEN 3 THEN 'youtube' ELSE 'web' END AS family FROM pages""")
def p10(spark, d):
    path, kind = U.path("url"), F.col("page_id") % 5
    where = (
        F.when(kind == 0, "https://Medium.com").when(kind == 1, "https://someone.medium.com")
        .when(kind == 2, "https://towardsdatascience.com").when(kind == 3, "https://m.youtube.com:443")
        .otherwise("https://www.towardsdatascience.com"))
    return table(spark, d, "pages").select("page_id", U.url_family(F.concat(where, path)).alias("family"))


@query("p11_drop_boilerplate", r"""SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda p: length(p) > 15 AND NOT regexp_matches(lower(p), 'prev|next|then|than')), '|') AS full_test,
 array_to_string(list_filter(string_split(text, chr(10)), lambda p: length(p) > 15 AND NOT regexp_matches(left(lower(p), 50), 'prev|next|then|than')), '|') AS head_test FROM documents""")
def p11(spark, d):
    phrases = ["prev", "next", "then", "than"]
    lines = F.split("text", "\n")
    return table(spark, d, "documents").select(
        "doc_id", F.array_join(S.drop_boilerplate(lines, phrases), "|").alias("full_test"),
        F.array_join(S.drop_boilerplate(lines, phrases, head=50), "|").alias("head_test"))


@query("p11_site_boilerplate", r"""SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda p: CASE doc_id % 3
  WHEN 0 THEN length(p) > 15 AND NOT regexp_matches(lower(p), 'prev chapter|next chapter|freewebnovel\.com|report chapter|tap the screen|log in')
  WHEN 1 THEN length(p) > 15 AND NOT regexp_matches(left(lower(p), 50), 'prev|next|comment|novelbin') ELSE true END), '|') AS kept FROM documents""")
def p11_site(spark, d):
    kind = F.col("doc_id") % 3
    site = F.when(kind == 0, "freewebnovel.com").when(kind == 1, "novelbin.com").otherwise("elsewhere")
    return table(spark, d, "documents").select(
        "doc_id", F.array_join(S.site_boilerplate(F.split("text", "\n"), site), "|").alias("kept"))


@query("p12_quality_gate", """SELECT doc_id, CASE WHEN coalesce(length(text), 0) < 400 THEN 'html has ' || coalesce(length(text), 0) || ' chars (min 400)'
 WHEN length(replace(text, 'e', '')) < 500 THEN 'text has ' || length(replace(text, 'e', '')) || ' chars (min 500)' END AS reject FROM documents""")
def p12(spark, d):
    rows = table(spark, d, "documents").select(
        "doc_id", F.col("text").alias("html"), F.replace("text", F.lit("e"), F.lit("")).alias("content"))
    return S.quality_gate(rows, html="html", min_html=400, min_text=500).select("doc_id", "reject")


@query("p13_chapter_range", f"WITH {CHAPTERS_SQL} SELECT novel_id, num FROM chapters WHERE num BETWEEN 2 AND 5")
def p13(spark, d):
    return S.chapter_range(I.chapters(spark, d), 2, 5).select("novel_id", "num")


@query("p14_set_columns", f"WITH {LEDGER_SQL} SELECT id, CASE WHEN source = 'site2' THEN 'failed' ELSE status END AS status, CASE WHEN source = 'site2' THEN NULL ELSE title END AS title, slug FROM ledger")
def p14(spark, d):
    changed = S.set_columns(
        I.ledger(spark, d), F.col("source") == "site2", allowed=["status", "title"], status="failed", title=None, slug="ignored")
    return changed.select("id", "status", "title", "slug")


@query("p15_dispatch_by_type", r"""SELECT 'https://example.com/' || doc_id AS url, CASE WHEN lang = 'en' THEN 'blog' ELSE 'glossary' END AS content_type,
 CASE WHEN lang = 'en' THEN 'Article ' ELSE 'Term ' END || doc_id AS title, CASE WHEN lang = 'en' THEN 'About ' ELSE '' END || lang AS description,
 CASE WHEN lang = 'en' THEN 'Databricks' ELSE 'Databricks Glossary' END AS folder,
 CASE WHEN lang = 'en' THEN 'clippings,databricks' ELSE 'clippings,databricks,glossary' END AS tags FROM documents WHERE lang <> 'en' OR doc_id % 7 <> 0""")
def p15(spark, d):
    kinds = table(spark, d, "documents").select(
        F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string")).alias("url"),
        F.when(F.col("lang") == "en", "blog").otherwise("glossary").alias("content_type"))
    blog = I.article_payloads(spark, d).join(kinds.filter("content_type = 'blog'"), "url")
    glossary = I.glossary_payloads(spark, d).join(kinds.filter("content_type = 'glossary'"), "url")
    rows = typed_payloads(blog.unionByName(glossary))
    labels = S.type_labels("content_type")
    return rows.select("url", "content_type", "title", "description", labels["folder"].alias("folder"), F.array_join(labels["tags"], ",").alias("tags"))


@query("o01_order_limit", f"WITH {LEDGER_SQL} SELECT id, slug FROM ledger WHERE status = 'pending' ORDER BY id LIMIT 250")
def o01(spark, d):
    return S.select_items(I.ledger(spark, d), status="pending", limit=250).select("id", "slug")


@query("o02_order_by_name", "SELECT c_name AS name, c_custkey AS id FROM customer ORDER BY c_name, c_custkey")
def o02(spark, d):
    return table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id")).orderBy("name", "id")


@query("u01_union_all", "SELECT url FROM pages UNION ALL SELECT split_part(url, '#', 1) FROM pages")
def u01(spark, d):
    pages = table(spark, d, "pages").select("url")
    return pages.unionByName(pages.select(F.substring_index("url", "#", 1).alias("url")))


@query("u02_union_distinct", """SELECT url, CAST(min(origin) AS BIGINT) AS origin FROM (SELECT url, 0 AS origin FROM pages UNION ALL SELECT split_part(url, '#', 1), 1 FROM pages) GROUP BY url""")
def u02(spark, d):
    pages = table(spark, d, "pages")
    first = pages.select("url", F.lit(0).cast("long").alias("origin"))
    second = pages.select(F.substring_index("url", "#", 1).alias("url"), F.lit(1).cast("long").alias("origin"))
    return dedup_first(first.unionByName(second), ["url"], ["origin"]).select("url", "origin")


@query("u03_difference", "SELECT url FROM pages WHERE url NOT IN (SELECT split_part(split_part(url, '#', 1), '?', 1) FROM pages)")
def u03(spark, d):
    pages = table(spark, d, "pages").select("url")
    known = pages.select(F.substring_index(F.substring_index("url", "#", 1), "?", 1).alias("url"))
    return J.difference(pages, known, ["url"])


@query("u04_merge_lists", """SELECT doc_id, 'clippings|' || lang || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '|extra|extra' END || '|' || source AS tags,
 'clippings|' || lang || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '|extra' END || '|' || source AS categories FROM documents""")
def u04(spark, d):
    base = F.array(F.lit("clippings"), "lang")
    extra = F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(F.array(F.lit("extra"), "lang", F.lit("extra"), "source"))
    return table(spark, d, "documents").select(
        "doc_id", F.array_join(T.merge_tags(base, extra), "|").alias("tags"),
        F.array_join(T.append_absent(base, extra), "|").alias("categories"))
