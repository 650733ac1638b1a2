"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.catalog import inputs as I
from gleaner.catalog.inputs import CHAPTERS_SQL, LEDGER_SQL, table
from gleaner.catalog.registry import query
from gleaner.catalog.sequence_queries import SPARSE_SQL, sparse_chapters
from gleaner.operators import joins as J
from gleaner.operators import offsets as O
from gleaner.session import scratch_path
from gleaner.sources.keyed import KeyedTable


@query("j01_list_with_counts", """SELECT c_custkey AS id, c_name AS name, coalesce(max(o_orderkey), 0) AS latest, count(o_orderkey) AS "count"
 FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name""")
def j01(spark, d):
    parents = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    children = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey")
    return J.list_with_counts(parents, children, "id", "o_orderkey")


@query("j02_discover_new", """SELECT text, doc_id AS ord, 'pending' AS status FROM (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text) WHERE text NOT IN (SELECT text FROM benchmark)""")
def j02(spark, d):
    """Documents as entries (with repeats); the texts of the benchmark are already known."""
    entries = table(spark, d, "documents").select("text", F.col("doc_id").alias("ord"))
    return J.discover_new(entries, table(spark, d, "benchmark"), ["text"], ["ord"])


@query("j02_discover_new_urls", """SELECT page_id, url, 'pending' AS status FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)""")
def j02_urls(spark, d):
    known = table(spark, d, "labels").select(F.col("doc_id").alias("page_id"))
    return J.discover_new(table(spark, d, "pages").select("page_id", "url"), known, ["page_id"], ["url"])


_UPSERT_SQL = """SELECT coalesce(d.doc_id, l.doc_id) AS id, coalesce(CASE WHEN l.quality = 1 THEN 'good ' || l.doc_id END, d.source) AS title,
 coalesce(CASE WHEN l.toxic = 0 THEN CAST(l.toxic AS BIGINT) END, d.n_chars) AS chars FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id"""


def _upsert_inputs(spark, d):
    base = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("n_chars").alias("chars"))
    incoming = table(spark, d, "labels").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("quality") == 1, F.concat(F.lit("good "), F.col("doc_id").cast("string"))).alias("title"),
        F.when(F.col("toxic") == 0, F.col("toxic").cast("long")).alias("chars"))
    return base, incoming


@query("j03_upsert_fill", _UPSERT_SQL)
def j03(spark, d):
    return J.upsert_fill(*_upsert_inputs(spark, d), ["id"], ["title", "chars"])


@query("j03_upsert_buckets", _UPSERT_SQL)
def j03_buckets(spark, d):
    """The labels change the buckets of a stored ledger that they belong to."""
    base, incoming = _upsert_inputs(spark, d)
    stored = KeyedTable(spark, scratch_path(spark, "ledger"), ["id"], buckets=16)
    stored.create(base)
    stored.upsert(incoming, ["title", "chars"])
    return stored.read()


@query("j03_upsert_repeats", """WITH last AS (SELECT user_id, arg_max('event ' || event_id, event_id) FILTER (event_type = 'error') AS title FROM events GROUP BY user_id)
 SELECT coalesce(c.c_custkey, l.user_id) AS id, coalesce(l.title, c.c_name) AS title FROM customer c FULL JOIN last l ON c.c_custkey = l.user_id""")
def j03_repeats(spark, d):
    """Many events of one item in a batch: the last present value counts."""
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    title = F.when(F.col("event_type") == "error", F.concat(F.lit("event "), F.col("event_id").cast("string")))
    incoming = table(spark, d, "events").select(F.col("user_id").alias("id"), title.alias("title"), "event_id")
    return J.upsert_fill(base, incoming, ["id"], ["title"], order="event_id")


_MOVED_SQL = f"""WITH {LEDGER_SQL}, moved AS (SELECT DISTINCT doc_id AS id FROM labels WHERE quality = 1)
 SELECT id, in_obsidian OR id IN (SELECT id FROM moved) AS in_obsidian, CASE WHEN id IN (SELECT id FROM moved) THEN '2024-05-06 00:00:00' END AS moved_at FROM ledger"""


@query("j04_mark_moved", _MOVED_SQL)
def j04(spark, d):
    moved = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    done = J.mark_moved(I.ledger(spark, d), moved, ["id"], F.lit("2024-05-06").cast("timestamp"))
    return done.select("id", "in_obsidian", F.date_format("moved_at", "yyyy-MM-dd HH:mm:ss").alias("moved_at"))


@query("j04_mark_moved_buckets", _MOVED_SQL)
def j04_buckets(spark, d):
    moved = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    stored = KeyedTable(spark, scratch_path(spark, "ledger"), ["id"], buckets=16)
    stored.create(I.ledger(spark, d).select("id", "in_obsidian", F.lit(None).cast("timestamp").alias("moved_at")))
    stored.mark_moved(moved, F.lit("2024-05-06").cast("timestamp"))
    return stored.read().withColumn("moved_at", F.date_format("moved_at", "yyyy-MM-dd HH:mm:ss"))


_LOCAL_SQL = "local AS (SELECT novel_id, num FROM chapters WHERE role = 'user' AND num % 3 <> 0)"


def _available_and_local(spark, d):
    available = I.chapters(spark, d).select("novel_id", "num", "role")
    return available.drop("role"), available.filter((F.col("role") == "user") & (F.col("num") % 3 != 0)).drop("role")


@query("j05_newer_than_local", f"""WITH {CHAPTERS_SQL}, {_LOCAL_SQL} SELECT novel_id, num FROM chapters c
 WHERE num > coalesce((SELECT max(num) FROM local l WHERE l.novel_id = c.novel_id), 0)""")
def j05(spark, d):
    return J.newer_than_local(*_available_and_local(spark, d))


@query("j05_newer_than_local_hot", f"""WITH {SPARSE_SQL}, local AS (SELECT novel_id, num FROM sparse WHERE num < 2000000000 AND num % 11 = 0)
 SELECT novel_id, num FROM sparse s WHERE num > coalesce((SELECT max(num) FROM local l WHERE l.novel_id = s.novel_id), 0)""")
def j05_hot(spark, d):
    """One novel has a third of all chapters."""
    available = sparse_chapters(spark, d).drop("role")
    return J.newer_than_local(available, available.filter((F.col("num") < 2_000_000_000) & (F.col("num") % 11 == 0)))


@query("j05_missing_locally", f"WITH {CHAPTERS_SQL}, {_LOCAL_SQL} SELECT novel_id, num FROM chapters EXCEPT SELECT novel_id, num FROM local")
def j05_missing(spark, d):
    return J.newer_than_local(*_available_and_local(spark, d), mode="missing")


@query("j06_asof_offset", """WITH m AS (SELECT conv_id, turn + 1 AS chapter, turn % 4 AS delta FROM conversations WHERE role = 'assistant' AND turn % 4 < 3)
 SELECT c.conv_id AS novel, c.turn + 1 AS num, coalesce(m.delta, 0) AS "offset", c.turn + 1 + coalesce(m.delta, 0) AS url_num
 FROM conversations c ASOF LEFT JOIN m ON c.conv_id = m.conv_id AND c.turn + 1 >= m.chapter""")
def j06(spark, d):
    turns = table(spark, d, "conversations")
    chapters = turns.select(F.col("conv_id").alias("novel"), (F.col("turn") + 1).alias("num"))
    mapped = turns.filter("role = 'assistant' AND turn % 4 < 3").select(
        F.col("conv_id").alias("novel"), (F.col("turn") + 1).alias("chapter"), (F.col("turn") % 4).alias("offset"))
    return O.asof_offset(chapters, mapped)


@query("j06_asof_offset_sparse", f"""WITH {SPARSE_SQL}, m AS (SELECT novel_id, num, num % 5 AS delta FROM sparse WHERE role = '1-URGENT')
 SELECT s.novel_id AS novel, s.num, coalesce(m.delta, 0) AS "offset", s.num + coalesce(m.delta, 0) AS url_num
 FROM sparse s ASOF LEFT JOIN m ON s.novel_id = m.novel_id AND s.num >= m.num""")
def j06_sparse(spark, d):
    chapters = sparse_chapters(spark, d).withColumnRenamed("novel_id", "novel")
    mapped = chapters.filter("role = '1-URGENT'").select("novel", F.col("num").alias("chapter"), (F.col("num") % 5).alias("offset"))
    return O.asof_offset(chapters.drop("role"), mapped)


@query("j07_detect_offset", """WITH observed AS (SELECT conv_id AS novel, turn + 1 AS url_n, turn + 1 - (turn % 4) + (conv_id % 3) AS actual FROM conversations),
 ranked AS (SELECT t.conv_id AS novel, t.turn + 1 AS num, o.url_n - o.actual AS diff,
  row_number() OVER (PARTITION BY t.conv_id, t.turn ORDER BY CASE WHEN o.url_n - o.actual >= 0 THEN o.url_n - o.actual ELSE 2 - (o.url_n - o.actual) END) AS rn
  FROM conversations t JOIN observed o ON o.novel = t.conv_id AND o.actual = t.turn + 1 AND abs(o.url_n - o.actual) <= 2 AND o.url_n > 0)
 SELECT t.conv_id AS novel, t.turn + 1 AS num, r.diff AS "offset" FROM conversations t LEFT JOIN ranked r ON r.novel = t.conv_id AND r.num = t.turn + 1 AND r.rn = 1""")
def j07(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("novel"), "turn")
    targets = turns.select("novel", (F.col("turn") + 1).alias("num"))
    actual = F.col("turn") + 1 - F.col("turn") % 4 + F.col("novel") % 3
    observed = turns.select("novel", (F.col("turn") + 1).alias("url_n"), actual.alias("actual"))
    return O.detect_offset(targets, observed, k=2)


@query("j08_first_success", """SELECT doc_id AS id, CASE WHEN lang = 'en' AND length(text) >= 400 THEN text WHEN lang IN ('en', 'fr') THEN 'service: ' || text WHEN source = 'src1' THEN 'last' END AS content,
 CAST(CASE WHEN lang = 'en' AND length(text) >= 400 THEN 0 WHEN lang IN ('en', 'fr') THEN 1 WHEN source = 'src1' THEN 2 END AS BIGINT) AS origin FROM documents""")
def j08(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "id")

    def stored(items):
        return items.filter("lang = 'en'").select("id", F.when(F.length("text") >= 400, F.col("text")).alias("content"))

    def service(items):
        return items.filter("lang IN ('en', 'fr')").select("id", F.concat(F.lit("service: "), "text").alias("content"))

    def page(items):
        return items.filter("source = 'src1'").select("id", F.lit("last").alias("content"))

    return J.first_success(docs, "id", stored, service, page).select("id", "content", F.col("origin").cast("long").alias("origin"))


def _bookmarks(spark, d):
    n = F.col("page_id").cast("string")
    kind = F.col("page_id") % 4
    url = (
        F.when(kind == 0, F.concat(F.lit("https://medium.com/@user/post-"), F.expr("page_id div 8").cast("string")))
        .when(kind == 1, F.concat(F.lit("https://itnext.io/post-"), n, F.lit(".html")))
        .otherwise(F.col("url")))
    return table(spark, d, "pages").select(
        F.col("page_id").alias("raindrop_id"), url.alias("url"), F.concat(F.lit("Page "), n).alias("title"))


_BOOKMARK_SQL = """marks AS (SELECT page_id AS raindrop_id, CASE page_id % 4 WHEN 0 THEN 'https://medium.com/@user/post-' || (page_id // 8)
 WHEN 1 THEN 'https://itnext.io/post-' || page_id || '.html' ELSE url END AS url,
 CASE page_id % 4 WHEN 0 THEN 'post-' || (page_id // 8) WHEN 1 THEN 'post-' || page_id END AS slug, page_id % 4 < 2 AS medium FROM pages)"""


@query("j09_route_items", f"WITH {_BOOKMARK_SQL} SELECT raindrop_id, url, CASE WHEN medium THEN 'skipped_medium' ELSE 'pending' END AS status, CASE WHEN medium THEN 'medium' END AS routed_to FROM marks")
def j09(spark, d):
    other = table(spark, d, "benchmark").select(F.concat(F.lit("post-"), F.col("item_id").cast("string")).alias("slug"))
    kept, _ = J.route_items(_bookmarks(spark, d), other)
    return kept.select("raindrop_id", "url", "status", "routed_to")


@query("j09_routed_entries", f"""WITH {_BOOKMARK_SQL}, firsts AS (SELECT slug, min(raindrop_id) AS raindrop_id FROM marks WHERE medium GROUP BY slug)
 SELECT m.slug, CASE WHEN m.url LIKE '%@user%' THEN 'user' ELSE '_raindrop_import' END AS username, m.url, 'Page ' || raindrop_id AS title, 'pending' AS status
 FROM firsts JOIN marks m USING (raindrop_id) WHERE m.slug NOT IN (SELECT 'post-' || item_id FROM benchmark)""")
def j09_routed(spark, d):
    other = table(spark, d, "benchmark").select(F.concat(F.lit("post-"), F.col("item_id").cast("string")).alias("slug"))
    _, routed = J.route_items(_bookmarks(spark, d), other)
    return routed.drop("raindrop_id")


@query("j10_supplement", """SELECT url, 'main' AS title FROM pages UNION ALL SELECT DISTINCT url || '.md', 'extra' FROM (SELECT split_part(url, '#', 1) AS url FROM pages) WHERE url NOT IN (SELECT url FROM pages)""")
def j10(spark, d):
    primary = table(spark, d, "pages").select("url", F.lit("main").alias("title"))
    bare = F.substring_index("url", "#", 1)
    extra = primary.select(F.concat(bare, F.lit(".md")).alias("url"), F.lit("extra").alias("title"))
    return J.supplement(primary, extra.union(extra))


@query("j11_remove_parents", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def j11(spark, d):
    removed = table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return J.remove_parents(table(spark, d, "orders").select("o_orderkey", "o_custkey"), removed, "o_custkey")


@query("j12_check_updates", f"""WITH {CHAPTERS_SQL}, {_LOCAL_SQL} SELECT novel_id, coalesce((SELECT max(num) FROM local l WHERE l.novel_id = c.novel_id), 0) AS local, max(num) AS available,
 greatest(0, max(num) - coalesce((SELECT max(num) FROM local l WHERE l.novel_id = c.novel_id), 0)) AS "new" FROM chapters c GROUP BY novel_id""")
def j12(spark, d):
    available, local = _available_and_local(spark, d)
    return J.check_updates(available.select("novel_id").distinct(), local, available, "novel_id", "num")


@query("j13_resolve_short_links", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'https://share.google/x' || page_id ELSE url END AS resolved FROM pages""")
def j13(spark, d):
    n, kind = F.col("page_id").cast("string"), F.col("page_id") % 5
    short = F.when(kind == 0, F.concat(F.lit("https://search.app/"), n)).when(kind == 1, F.concat(F.lit("https://share.google/x"), n))
    pages = table(spark, d, "pages")
    items = pages.select("page_id", F.coalesce(short, "url").alias("url"))
    redirects = pages.select(
        short.alias("url"), F.when(kind == 0, F.col("url")).otherwise(F.concat(F.lit("https://search.app/z"), n)).alias("final_url"))
    return J.resolve_short_links(items, redirects.filter("url IS NOT NULL")).select("page_id", "resolved")
