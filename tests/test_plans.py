"""Physical plans: no cross joins, no row-at-a-time Python, filters and columns reach the scan."""

import re

import pytest

from gleaner.catalog import load

QUERIES = load()[0]
PYTHON = {"h01_pages_to_markdown", "h01_pages_to_markdown_strict", "h01_extract_articles", "h04_nested_lists",
          "h05_admonitions", "h15_article_notes", "run_blog_ledger", "run_blog_fallback", "run_second_blog_ledger", "run_docs_notes",
          "h10_chapter_text", "h10_read_chapters", "crawl_pages", "crawl_report"}
BATCH = [n for n in QUERIES if not n.startswith("r0")]


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_plan_of_query(spark, sf_dir, name):
    plan = _plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "MapInPandas" not in plan
    assert ("ArrowEvalPython" in plan) == (name in PYTHON)


def test_filter_reaches_the_scan(spark, sf_dir):
    plan = _plan(QUERIES["s01_read_ledger"](spark, sf_dir))
    assert "EqualTo(source,src3)" in plan and "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in plan


@pytest.mark.parametrize("name, columns", [
    ("f09_slug_path", "page_id:bigint,url:string"), ("f31_word_and_char_count", "doc_id:bigint,text:string"),
    ("a10_distinct_sites", "source:string"), ("p07_is_localized", "page_id:bigint,url:string"),
])
def test_scan_reads_only_needed_columns(spark, sf_dir, name, columns):
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", _plan(QUERIES[name](spark, sf_dir)))) == {columns}


@pytest.mark.parametrize("name", ["a01_status_counts", "a05_run_summary", "w03_dedup_first", "j01_list_with_counts", "j07_detect_offset"])
def test_aggregates_reduce_before_the_shuffle(spark, sf_dir, name):
    assert "partial_" in _plan(QUERIES[name](spark, sf_dir))


def test_scalar_functions_do_not_shuffle(spark, sf_dir):
    for name in BATCH:
        if name.startswith("f"):
            assert "Exchange" not in _plan(QUERIES[name](spark, sf_dir)), name


def test_chapters_are_read_once(spark, sf_dir):
    plan = _plan(QUERIES["h10_read_chapters"](spark, sf_dir))
    assert plan.count("ArrowEvalPython") == 1 and plan.count("regexp_") < 250, plan.count("regexp_")
