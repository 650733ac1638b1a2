"""Ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.catalog import inputs as I
from gleaner.catalog.functions_queries import SERIES_SQL, series_titles
from gleaner.catalog.inputs import CHAPTERS_SQL, LEDGER_SQL, table
from gleaner.catalog.registry import query
from gleaner.functions import html as H
from gleaner.operators import sequences as Q


@query("w01_chapter_nav", f"""WITH {CHAPTERS_SQL}, linked AS (SELECT novel_id, num, lag(num) OVER w AS prev_num, lead(num) OVER w AS next_num FROM chapters WINDOW w AS (PARTITION BY novel_id ORDER BY num))
 SELECT novel_id, num, prev_num, next_num, repeat(chr(10), 2) || '---' || repeat(chr(10), 2) || '<!-- nav-footer -->' || chr(10)
 || CASE WHEN prev_num IS NULL THEN '*(first)*' ELSE printf('[[%04d - The Story Of %d|← Ch %d]]', prev_num, novel_id, prev_num) END || ' | '
 || printf('[[The_Story_Of_%d_Index|Index]]', novel_id) || ' | '
 || CASE WHEN next_num IS NULL THEN '*(last)*' ELSE printf('[[%04d - The Story Of %d|Ch %d →]]', next_num, novel_id, next_num) END || chr(10) AS footer FROM linked""")
def w01(spark, d):
    return Q.chapter_nav(I.chapters(spark, d))


# Hashed chapter numbers; every third order belongs to one hot novel.
SPARSE_SQL = """sparse AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS novel_id,
 o_orderkey * 2654435761 % 4294967291 AS num, o_orderpriority AS role FROM orders)"""


def sparse_chapters(spark, d):
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        F.when(key % 3 == 0, 0).otherwise(F.col("o_custkey")).cast("long").alias("novel_id"),
        (key * 2654435761 % 4294967291).alias("num"), F.col("o_orderpriority").alias("role"))


@query("w01_sparse_nav", f"""WITH {SPARSE_SQL} SELECT novel_id, num, lag(num) OVER w AS prev_num, lead(num) OVER w AS next_num FROM sparse
 WINDOW w AS (PARTITION BY novel_id ORDER BY num)""")
def w01_sparse(spark, d):
    return Q.neighbours(sparse_chapters(spark, d).drop("role"), ["novel_id"], ["num"], ["num"])


@query("w07_skip_headers_sparse", f"""WITH {SPARSE_SQL} SELECT novel_id, num FROM sparse s
 WHERE num >= (SELECT min(num) FROM sparse x WHERE x.novel_id = s.novel_id AND x.role <> '1-URGENT')""")
def w07_sparse(spark, d):
    rows = Q.skip_leading_headers(sparse_chapters(spark, d), ["novel_id"], "num", F.col("role") == "1-URGENT")
    return rows.select("novel_id", "num")


@query("w02_series_nav", f"""WITH {SERIES_SQL}, many AS (SELECT *, count(*) OVER (PARTITION BY base) AS n FROM series WHERE base IS NOT NULL),
 linked AS (SELECT p_partkey AS id, base, part, lag(title) OVER w AS prev_title, lead(title) OVER w AS next_title FROM many WHERE n >= 2 WINDOW w AS (PARTITION BY base ORDER BY part, p_partkey))
 SELECT id, base, part, prev_title, next_title FROM linked""")
def w02(spark, d):
    posts = series_titles(spark, d).withColumnRenamed("p_partkey", "id")
    return Q.series_nav(posts).drop("block")


@query("w03_dedup_first", "SELECT text, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def w03(spark, d):
    docs = table(spark, d, "documents").select("text", "doc_id", "source")
    return Q.dedup_first(docs, ["text"], ["doc_id"])


@query("w04_ordinal", r"""WITH items AS (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS li FROM pages)
 SELECT page_id, array_to_string(list_filter(list_transform(li, lambda x, i: CASE WHEN i = 2 THEN NULL ELSE i || '. ' || regexp_replace(x, '<[^>]*>', '', 'g') END), lambda x: x IS NOT NULL), chr(10)) AS lines FROM items""")
def w04(spark, d):
    """Navigation items as a numbered list; the second one is made blank and still counts."""
    items = F.transform(H.list_items("html"), lambda x, i: F.when(i == 1, " ").otherwise(H.visible_text(x)))
    return table(spark, d, "pages").select("page_id", F.array_join(Q.ordinal_lines(items), "\n").alias("lines"))


@query("w05_assign_ids", f"""WITH {LEDGER_SQL} SELECT slug, (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY id) AS id FROM ledger WHERE status = 'pending'""")
def w05(spark, d):
    new = I.ledger(spark, d).filter("status = 'pending'").select(F.col("id").alias("ord"), "slug")
    known = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return Q.assign_ids(new, known, "ord").select("slug", "id")


_ARTICLE_SQL = r"trim(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>', '', 'g'), ' ' || chr(10))"


@query("w06_first_by_priority", rf"""WITH t AS (SELECT page_id, {_ARTICLE_SQL} AS a, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS tt FROM pages)
 SELECT page_id, CASE WHEN length(a) >= 3000 THEN 'article' WHEN length(h) >= 30 THEN 'h1' WHEN length(tt) > 0 THEN 'title' END AS origin FROM t""")
def w06(spark, d):
    text = H.strip_tags(F.regexp_extract("html", r"(?s)<article>(.*?)</article>", 1))
    text = F.btrim(text, F.lit(" \n"))
    heading = F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1)
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return table(spark, d, "pages").select("page_id", Q.first_by_priority(
        (F.length(text) >= 3000, F.lit("article")), (F.length(heading) >= 30, F.lit("h1")),
        (F.length(title) > 0, F.lit("title"))).alias("origin"))


@query("w07_skip_leading_headers", f"""WITH {CHAPTERS_SQL} SELECT novel_id, num, role FROM chapters c WHERE num >= (SELECT min(num) FROM chapters x WHERE x.novel_id = c.novel_id AND x.role <> 'system')""")
def w07(spark, d):
    rows = I.chapters(spark, d).select("novel_id", "num", "role")
    return Q.skip_leading_headers(rows, ["novel_id"], "num", F.col("role") == "system")
