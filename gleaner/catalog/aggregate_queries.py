"""Aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.catalog import inputs as I
from gleaner.catalog.functions_queries import SERIES_SQL, series_titles
from gleaner.catalog.inputs import CHAPTERS_SQL, LEDGER_SQL, table
from gleaner.catalog.registry import query
from gleaner.functions import text as T
from gleaner.operators import aggregates as A
from gleaner.operators import joins as J
from gleaner.operators import offsets as O


@query("a01_status_counts", f"""WITH {LEDGER_SQL} SELECT CASE WHEN grouping(source) = 1 THEN '*' ELSE source END AS source, CASE WHEN grouping(status) = 1 THEN 'total' ELSE status END AS status, count(*) AS "count"
 FROM ledger GROUP BY ROLLUP (source, status)""")
def a01(spark, d):
    return A.status_counts(I.ledger(spark, d), ["source"])


@query("a02_progress", f"""WITH {LEDGER_SQL} SELECT CASE WHEN grouping(content_type) = 1 THEN '*' ELSE content_type END AS content_type, count(*) AS total,
 count(*) FILTER (status = 'downloaded') AS downloaded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending,
 round(count(*) FILTER (status = 'downloaded') * CAST(100.0 AS DOUBLE) / count(*), 1) AS pct FROM ledger GROUP BY ROLLUP (content_type)""")
def a02(spark, d):
    return A.progress(I.ledger(spark, d), "content_type")


@query("a03_latest_num", "SELECT c_custkey AS id, coalesce(max(o_orderkey), 0) AS latest FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def a03(spark, d):
    parents = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return A.latest_num(parents, table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey"), "id", "o_orderkey")


@query("a04_reset_failed", f"""WITH {LEDGER_SQL} SELECT id, CASE WHEN status = 'failed' AND source = 'site1' THEN 'pending' ELSE status END AS status,
 CASE WHEN source = 'site1' THEN NULL ELSE error_reason END AS error_reason, CASE WHEN source = 'site1' THEN NULL ELSE error_detail END AS error_detail FROM ledger""")
def a04(spark, d):
    return A.reset_failed(I.ledger(spark, d), "site1").select("id", "status", "error_reason", "error_detail")


@query("a04_pending_after_reset", f"""WITH {LEDGER_SQL} SELECT count(*) AS "count" FROM ledger WHERE status IN ('failed', 'pending')""")
def a04_count(spark, d):
    return A.count_status(A.reset_failed(I.ledger(spark, d)))


@query("a05_run_summary", f"""WITH {LEDGER_SQL} SELECT strftime(downloaded_at, '%Y-%m-%d') AS run, count(*) AS total, count(*) FILTER (status = 'downloaded') AS downloaded, count(*) FILTER (status = 'failed') AS failed,
 CASE WHEN count(*) FILTER (status = 'failed') = 0 THEN 'success' ELSE 'partial' END AS status FROM ledger GROUP BY 1""")
def a05(spark, d):
    return A.run_summary(I.ledger(spark, d).withColumn("run", T.day("downloaded_at")), ["run"])


@query("a06_total_new", f"""WITH {CHAPTERS_SQL}, checks AS (SELECT novel_id, max(num) - coalesce(max(num) FILTER (role = 'user'), 0) AS "new" FROM chapters GROUP BY novel_id)
 SELECT count(*) AS parents, CAST(coalesce(sum("new"), 0) AS BIGINT) AS total_new FROM checks WHERE "new" > 0""")
def a06(spark, d):
    chapters = I.chapters(spark, d).select("novel_id", "num", "role")
    local = chapters.filter("role = 'user'")
    return A.total_new(J.check_updates(chapters.select("novel_id").distinct(), local, chapters, "novel_id", "num"))


@query("a07_series_groups", f"WITH {SERIES_SQL} SELECT base, count(*) AS parts FROM series WHERE base IS NOT NULL GROUP BY base HAVING count(*) >= 2")
def a07(spark, d):
    found = T.one_if(T.series_part("title"), lambda s: s.isNotNull())
    parts = series_titles(spark, d).select(found.alias("s")).select("s.base")
    return A.series_groups(parts, "base", 2)


@query("a08_group_span", f"""WITH {CHAPTERS_SQL} SELECT novel_id, count(*) AS "count", min(num) AS "first", max(num) AS "last" FROM chapters WHERE role <> 'system' GROUP BY novel_id""")
def a08(spark, d):
    return A.group_span(I.chapters(spark, d).filter("role <> 'system'"), "novel_id", "num")


@query("a09_join_in_order", f"""WITH {CHAPTERS_SQL} SELECT novel_id, num // 1000 AS page, string_agg(text, chr(10) || chr(10) ORDER BY num) AS content FROM chapters GROUP BY 1, 2""")
def a09(spark, d):
    """Chapters of a novel as one text, in pages of a thousand chapters."""
    paged = I.chapters(spark, d).withColumn("page", F.expr("num div 1000"))
    return A.join_in_order(paged, ["novel_id", "page"], "num", "text", "\n\n", "content")


@query("a10_distinct_sites", "SELECT DISTINCT source FROM documents")
def a10(spark, d):
    return A.distinct_sites(table(spark, d, "documents"))


@query("a11_pipeline_summary", """WITH steps AS (SELECT CASE user_id % 4 WHEN 0 THEN 'Docs' WHEN 1 THEN 'Blogs' WHEN 2 THEN 'Novels' ELSE 'Medium' END AS pipeline, user_id % 4 AS ord,
  CASE WHEN user_id % 4 = 3 THEN 'ok' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' AND user_id % 4 < 2 THEN 'config_error' ELSE 'ok' END AS outcome FROM events),
 per AS (SELECT pipeline, min(ord) AS ord, CASE WHEN pipeline = 'Docs' AND bool_or(outcome = 'config_error') THEN 'config_error' WHEN bool_and(outcome = 'ok') THEN 'done'
  WHEN bool_or(outcome = 'config_error') THEN 'config_error' ELSE 'failed' END AS status FROM steps GROUP BY pipeline)
 SELECT string_agg(pipeline || ': ' || status, ' | ' ORDER BY ord) AS summary FROM per""")
def a11(spark, d):
    slot, kind = F.col("user_id") % 4, F.col("event_type")
    steps = table(spark, d, "events").select(
        F.when(slot == 0, "Docs").when(slot == 1, "Blogs").when(slot == 2, "Novels").otherwise("Medium").alias("pipeline"),
        slot.alias("ord"),
        F.when(slot == 3, "ok").when(kind == "error", "failed").when((kind == "signup") & (slot < 2), "config_error").otherwise("ok").alias("outcome"))
    return A.pipeline_summary(steps)


@query("a12_offset_summary", """SELECT conv_id AS novel, turn // 100 AS part, count(*) FILTER (role <> 'system') AS success, count(*) FILTER (role = 'system') AS failed,
 coalesce(string_agg('' || (turn + 1) || ':' || (turn % 3) || ':' || (turn + 1 + turn % 3), ',' ORDER BY turn) FILTER (role <> 'system'), '') AS offsets FROM conversations GROUP BY 1, 2""")
def a12(spark, d):
    runs = table(spark, d, "conversations").select(
        F.col("conv_id").alias("novel"), F.expr("turn div 100").alias("part"), (F.col("turn") + 1).alias("num"),
        F.when(F.col("role") != "system", F.col("turn") % 3).alias("offset"))
    return O.offset_summary(runs)
