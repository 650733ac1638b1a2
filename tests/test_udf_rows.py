"""The HTML readers hand results on slice by slice, so that those of a whole batch never wait in memory; row by row they are the same."""

import pyarrow as pa
from pyspark.sql import functions as F

from gleaner.operators import html_blocks as helper
from gleaner.operators.markdown import PROFILES, element_paragraphs, html_blocks

PAGE = "<body><article><h2>T &amp; t {0}</h2><p>one <b>two</b> {0}</p><table><tr><td>a</td><td>b</td></tr></table></article></body>"


def pages(spark, rows=1000):
    texts = [None if i % 9 == 0 else "" if i % 9 == 1 else PAGE.format(i) for i in range(rows)]
    names = [None if i % 7 == 0 else "other" if i % 7 == 1 else "docs_page" for i in range(rows)]
    data = list(zip(range(rows), texts, names))
    return data, spark.createDataFrame(data, "id long, html string, name string").coalesce(1)


def largest_result(udf, monkeypatch):
    """Most rows of one result when a batch of 1,000 rows goes through the function that Spark calls."""
    made = []
    monkeypatch.setattr(F, "arrow_udf", lambda returns: lambda f: lambda *columns: made.append(f))
    udf()
    texts, names = pa.array([PAGE] * 1000), pa.array(["docs_page"] * 1000)
    results = list(made[0](iter([(texts, names)])))
    assert sum(map(len, results)) == 1000
    return max(map(len, results))


def test_results_leave_in_slices(monkeypatch):
    assert largest_result(lambda: html_blocks("html", PROFILES, "name"), monkeypatch) <= helper.SLICE_ROWS
    assert largest_result(lambda: element_paragraphs("html", {"docs_page": ["p"]}, "name"), monkeypatch) <= helper.SLICE_ROWS


def test_blocks_of_rows_row_by_row(spark):
    data, table = pages(spark)
    read = table.select("id", html_blocks("html", PROFILES, "name").alias("b"))
    got = {r.id: r.b for r in read.collect()}
    for i, text, name in data:
        blocks = helper.Blocks()
        if text is not None and name in PROFILES:
            blocks.read(text, PROFILES[name])
        assert (got[i] is None) == (text is None)
        assert text is None or [tuple(b) for b in got[i]] == list(zip(*blocks.columns))
    assert len(got) == len(data) and [b.kind for b in got[2]] == ["heading", "paragraph", "table"] and got[2][2].rows == [["a", "b"]]


def test_paragraphs_of_rows_row_by_row(spark):
    data, table = pages(spark)
    read = table.select("id", element_paragraphs("html", {"docs_page": ["article", ".none"]}, F.col("name")).alias("p"))
    got = {r.id: r.p for r in read.collect()}
    for i, text, name in data:
        known = text is not None and name == "docs_page"
        assert got[i] == ([[f"one two {i}"] if text else None, None] if known and text else [None, None] if known else None)
