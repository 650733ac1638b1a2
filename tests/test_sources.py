"""Sources and sinks that need files, deep nesting or broken input."""

import json

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators.joins import discover_new
from gleaner.plans import blogs
from gleaner.profiles import SITES, SiteProfile, doc_entries, register_site
from gleaner.sources import feeds, links, payloads, sitemaps, tables, trees

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def _index(*locs):
    return f"<sitemapindex {NS}>" + "".join(f"<sitemap><loc>\n {x} </loc></sitemap>" for x in locs) + "</sitemapindex>"


def _urls(*locs):
    return f"<?xml version='1.0'?><urlset {NS}>" + "".join(f"<url><loc>{x}</loc><lastmod>1</lastmod></url>" for x in locs) + "</urlset>"


def _docs(spark, *rows):
    return spark.createDataFrame(rows, "url string, body string")


def test_sitemaps_of_any_depth_with_a_cycle(spark):
    docs = _docs(
        spark, ("r", _index("a", "b-blog")), ("b-blog", _index("c-blog", "r-blog", "missing-blog")), ("c-blog", _index("d-blog", "b-blog")),
        ("d-blog", _urls("u1", "u2")), ("a", _urls("u3")), ("broken", "<urlset"), ("x", _urls("u4")))
    roots = spark.createDataFrame([("r",), ("broken",)], "url string")
    assert [r["url"] for r in sitemaps.expand_sitemaps(docs, roots, ["BLOG"]).orderBy("ord").collect()] == ["u1", "u2"]
    everything = sitemaps.expand_sitemaps(docs, roots)
    assert sorted(r["url"] for r in everything.collect()) == ["u1", "u2", "u3"]


def test_sitemap_fallback_is_for_roots_only(spark):
    docs = _docs(spark, ("r", _index("a")), ("a", _index("b")), ("b", _urls("u1")))
    roots = spark.createDataFrame([("r",)], "url string")
    assert sitemaps.expand_sitemaps(docs, roots, ["blog"], fallback=True).count() == 0
    assert sitemaps.expand_sitemaps(docs, roots, ["b"], fallback=True).count() == 1


def test_sitemap_chain_of_any_depth(spark):
    docs = _docs(spark, *[(f"s{i}", _index(f"s{i + 1}")) for i in range(18)], ("s18", "<urlset><url><loc>https://x/p</loc></url></urlset>"))
    found = sitemaps.expand_sitemaps(docs, spark.createDataFrame([("s0",)], "url string"), ["s"]).collect()
    assert [(r["sitemap"], r["url"]) for r in found] == [("s18", "https://x/p")]


def test_long_numbers_give_null(spark):
    long = "9" * 25
    page = spark.createDataFrame([("k", f"<a href='/novel/chapter-{long}'>x</a><a href=/novel/chapter-7>y</a>")], "key string, html string")
    assert links.highest_chapter(page).first()["max_num"] == 7
    row = spark.range(1).select(
        T.chapter_no(F.lit(f"Chapter {long}"), F.lit("")), T.chapter_no_from_page(F.lit(f"Chapter {long}"), F.lit("")),
        T.chapter_no_from_file(F.lit(f"Chapter_{long}"))).first()
    assert tuple(row) == (None, None, None)


def test_feed_dates_fall_back_to_updated(spark):
    body = "<rss><channel><item><link>https://m.com/@u/some-post-00000001</link><updated>2024-03-04T05:06:07Z</updated></item><item><link>https://m.com/@u/b-2</link></item></channel></rss>"
    rows = feeds.rss_items(spark.createDataFrame([("u", body)], "username string, body string")).orderBy("ord").collect()
    assert [str(r["updated_date"]) for r in rows] == ["2024-03-04", "None"]


def test_entries_come_in_the_order_of_the_walk(spark):
    def index(url, *locs):
        return url, "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"

    def urls(url, *locs):
        return url, "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in locs) + "</urlset>"

    post = "https://b.com/blog/"
    docs = _docs(spark, index("r", "z", "m", "deep"), index("deep", "a"), urls("z", post + "one", post + "two/"),
                 urls("m", post + "two", post + "one/"), urls("a", post + "three", post + "one?x"), index("r2", "m"))
    roots = spark.createDataFrame([("r2", 5), ("r", 1)], "url string, ord int")
    entries = sitemaps.expand_sitemaps(docs, roots).orderBy("path", "ord").collect()
    assert [(r.sitemap, r.path, r.ord) for r in entries] == [
        ("z", [1, 0], 0), ("z", [1, 0], 1), ("m", [1, 1], 0), ("m", [1, 1], 1), ("a", [1, 2, 0], 0), ("a", [1, 2, 0], 1)]
    found = sitemaps.expand_sitemaps(docs, roots).select(F.regexp_extract("url", "blog/([a-z]+)", 1).alias("slug"), "url", "path", "ord", "sitemap")
    ledger = spark.createDataFrame([("three",)], "slug string")
    new = discover_new(found, ledger, ["slug"], blogs.ENCOUNTER)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert {(r.slug, r.url) for r in new.collect()} == {("one", post + "one"), ("two", post + "two/")}  # by path; the sitemap's name would say "a"
    assert not any("url" in line.split("functions=")[-1] for line in plan.splitlines() if "SortAggregate" in line)


def test_page_tree_beyond_three_levels(spark):
    def page(name, *children):
        return {"type": "page", "href": f"/en/{name}", "label": name, "children": list(children)}

    def section(*children):
        return {"type": "section", "title": "s", "children": list(children)}

    tree = page("a", section(page("b", section(section(page("c", page("d"), page("e"))))), page("f")), {"type": "page", "href": "", "children": [page("g")]})
    forest = spark.createDataFrame([("k", json.dumps(tree)), ("bad", "{"), ("leaf", '{"type":"page","href":"/x/y","title":"T","children":null}')], "key string, node string")
    rows = trees.page_tree(forest, "https://d").orderBy("key", "ord").collect()
    assert [(r["slug"], r["parent_path"]) for r in rows if r["key"] == "k"] == [
        ("a", ""), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "c"), ("f", "a"), ("g", "a")]
    assert [(r["slug"], r["url"], r["title"]) for r in rows if r["key"] == "leaf"] == [("x/y", "https://d/x/y", "T")]


def test_page_tree_of_depth_100_is_one_recursive_plan(spark):
    node = {"type": "page", "href": "/en/p100", "label": "P100", "children": {"not": "a list"}}
    for level in range(99, 0, -1):
        node = {"type": "page" if level % 2 else "section", "href": f"/en/p{level}", "label": f"P{level}", "children": [None, 7, node]}
    forest = spark.createDataFrame([("deep", json.dumps(node)), ("null", None), ("number", "1")], "key string, node string")
    found = trees.page_tree(forest, "https://d")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("UnionLoop ") == 1 and "to_json" not in plan and "Exchange" not in plan and plan.count("parseJson") == 1
    rows = sorted(found.collect(), key=lambda r: len(r["ord"]))
    assert [r["slug"] for r in rows] == [f"p{i}" for i in [*range(1, 100, 2), 100]]
    assert [r["parent_path"] for r in rows[1:]] == [r["slug"] for r in rows[:-1]]
    assert rows[-1]["ord"] == [2] * 99


def test_feed_items_without_link_drop(spark):
    body = ('<rss xmlns:dc="d" xmlns:content="c"><channel><item><title>A</title><link>https://m.com/@u/a-1</link>'
            '<description>&lt;p&gt;x&lt;/p&gt;</description></item><item><title>B</title></item></channel></rss>')
    rows = feeds.rss_items(spark.createDataFrame([("u", body), ("v", "<rss")], "username string, body string")).collect()
    assert [(r["slug"], r["description"], r["categories"]) for r in rows] == [("a-1", "x", None)]


def test_article_payload_rules(spark):
    def payload(**fields):
        return json.dumps({"result": {"data": {"drupal": {"article": fields}}}})

    rows = [
        ("full", payload(title="T", fieldAuthors=[{"entity": {"name": "A"}}, {"entity": None}], fieldDate="2024-01-02x",
                         fieldCategories=[{"entity": {"name": "c"}}], fieldTags=[{"entity": {"name": "c"}}, {"entity": {"name": "t"}}],
                         body={"processed": "<p>b</p>"})),
        ("no title", payload(body={"processed": "b"})), ("no body", payload(title="T")), ("empty", "{}"), ("broken", "{"),
    ]
    found = payloads.article_json(_docs(spark, *rows)).collect()
    assert [r["url"] for r in found] == ["full"]
    assert (found[0]["authors"], found[0]["categories"], str(found[0]["date"]), found[0]["description"]) == (["A"], ["c", "t"], "2024-01-02", "")


def test_chapter_links(spark):
    html = ('<a href="/novel/s/chapter-9">Prologue</a><a title="Nine" href="/novel/s/x">CHAPTER 8</a><a href="/novel/s/?tab=1">Chapter 7</a>'
            '<a href="/other/chapter-6">Chapter 6</a><a href="/novel/s/about">About</a><a href="/novel/s/chapter-5"> </a>')
    rows = links.chapter_links(spark.createDataFrame([("k", html)], "key string, html string")).orderBy("ord").collect()
    assert [(r["num"], r["title"]) for r in rows] == [(9, "Prologue"), (8, "Nine")]


def test_ledger_round_trip_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "ledger")
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, source string")
    tables.write_ledger(old, path)
    new = spark.createDataFrame([(3, "a", "glossary")], "id long, source string, content_type string")
    new.write.mode("append").partitionBy("source").parquet(path)
    found = tables.read_ledger(spark, path, "a")
    assert sorted((r["id"], r["content_type"]) for r in found.collect()) == [(1, "blog"), (3, "glossary")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan


def test_note_files_and_vault_scan(spark, tmp_path):
    notes = spark.createDataFrame(
        [("My Novel/0001 - My Novel.md", "one"), ("My Novel/0012 - My Novel.md", "zwölf"), ("My Novel/My_Novel_Index.md", "i"), ("A+B%/0003 - x.md", "y")],
        "path string, content string")
    tables.write_note_files(notes, str(tmp_path))
    assert (tmp_path / "My Novel" / "0012 - My Novel.md").read_text(encoding="utf-8") == "zwölf"
    found = {(r["novel"], r["num"], r["site"]) for r in tables.scan_vault(spark, str(tmp_path)).collect()}
    assert found == {("My Novel", 1, "imported"), ("My Novel", 12, "imported"), ("A+B%", 3, "imported")}


def test_run_log_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    run = spark.createDataFrame([("s", 1)], "source string, total long")
    tables.append_run_log(run, path)
    tables.append_run_log(run, path)
    assert spark.read.parquet(path).count() == 2


def test_json_report_keeps_nulls_and_dates(spark):
    frame = spark.createDataFrame([(1, None)], "id long, title string").withColumn("day", F.lit("2024-05-06").cast("date"))
    assert tables.to_json_report(frame).first()["json"] == '{"id":1,"title":null,"day":"2024-05-06"}'


def test_registered_site(spark):
    register_site(SiteProfile("mine", "My Docs", "https://my.example.com", drop_html=True, tag_clouds=True))
    try:
        pages = spark.createDataFrame([("mine", "https://my.example.com/GCP/a/b.html"), ("none", "https://x/y")], "site string, url string")
        row, = doc_entries(pages).collect()
        assert (row["slug"], row["parent_path"], row["path"], row["tags"]) == (
            "GCP/a/b", "GCP/a", "My Docs/GCP/a/b.md", ["clippings", "documentation", "mine", "gcp"])
    finally:
        del SITES["mine"]


def test_failed_write_leaves_no_file(spark, tmp_path):
    tables.write_note_files(spark.createDataFrame([("a/one.md", "old")], "path string, content string"), str(tmp_path))
    rows = spark.range(200).select(
        F.concat(F.lit("a/"), F.col("id"), F.lit(".md")).alias("path"),
        F.when(F.col("id") == 150, F.raise_error(F.lit("broken"))).otherwise("text").alias("content"))
    with pytest.raises(Exception, match="broken"):
        tables.write_note_files(rows.repartition(4, "path"), str(tmp_path))
    with pytest.raises(Exception, match="leaves the folder"):
        tables.write_note_files(spark.createDataFrame([("../up.md", "x"), ("b.md", "y")], "path string, content string"), str(tmp_path))
    assert sorted(str(f.relative_to(tmp_path)) for f in tmp_path.rglob("*") if f.is_file()) == ["a/one.md"]


def test_note_files_round_trip(spark, tmp_path):
    rows = [(f"hot/{i}.md", f"line\r\n{i}\n") for i in range(60)] + [("top.md", None), ("deep/er/x.md", "ä"), ("deep/skip.txt", "no note")]
    root = f"file:{tmp_path}"
    tables.write_note_files(spark.createDataFrame(rows, "path string, content string").repartition(5), root)
    tables.write_note_files(spark.createDataFrame([("top.md", "new")], "path string, content string"), root)
    read = tables.read_note_files(spark, root)
    assert {tuple(r) for r in read.collect()} == {(p, c) for p, c in rows if p.endswith(".md") and p != "top.md"} | {("top.md", "new")}
    assert {r.content for r in tables.read_note_files(spark, root, contents=False).collect()} == {None}
    assert sum(r["count"] > 0 for r in read.where("path like 'hot/%'").groupBy(F.spark_partition_id()).count().collect()) == 4
    assert not list(tmp_path.glob("_writing"))
    with pytest.raises(ValueError, match="mounted"):
        tables.write_note_files(read, "s3a://bucket/x")
