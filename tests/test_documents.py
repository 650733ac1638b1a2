"""Paragraph JSON, chapters, old files and documentation pages on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from gleaner import values as V
from gleaner.operators import documents as D
from gleaner.plans import docs, feeds
from gleaner.sources.tables import write_line_files


def _markdown(one, *paragraphs):
    return one(D.paragraphs_markdown("b"), b=json.dumps(list(paragraphs)))


P = {"type": "P", "text": "end"}


@pytest.mark.parametrize("marks, expected", [
    ([("STRONG", 0, 3), ("EM", 4, 7)], "**abc** *def*"),
    ([("EM", 4, 7), ("CODE", 0, 3)], "`abc` *def*"),
    ([("A", 0, 3)], "[abc](http://x) def"),
    ([("STRONG", 3, 4), ("EM", 5, 5), ("OTHER", 0, 3)], "abc def"),
    # Equal starts keep their order; the second one sees the text the first one left.
    ([("STRONG", 0, 3), ("EM", 0, 3)], "***a*bc** def"),
    # The outer span keeps its numbers after the inner one grew.
    ([("EM", 0, 7), ("STRONG", 4, 7)], "*abc **d*ef**"),
])
def test_markups(one, marks, expected):
    markups = [{"type": t, "start": s, "end": e, "href": "http://x" if t == "A" else None} for t, s, e in marks]
    text = _markdown(one, {"type": "P", "text": "abc def", "markups": markups}, P, P)
    assert text == f"{expected}\n\nend\n\nend"


def test_paragraph_kinds(one):
    text = _markdown(
        one, {"type": "H3", "text": "Title"}, {"type": "H4", "text": "Sub"},
        {"type": "IMG", "text": "cap", "metadata": {"id": "1*x.png"}}, {"type": "IMG", "text": "none"},
        {"type": "H3", "text": "Head"}, {"type": "ULI", "text": "a"}, {"type": "OLI", "text": "b"},
        {"type": "BQ", "text": " q1 \n\n q2"}, {"type": "MIXTAPE_EMBED", "text": "", "href": "http://y"}, {"type": "ODD", "text": "odd"})
    assert text == (
        "![cap](https://cdn-images-1.medium.com/max/1024/1*x.png)\n\n## Head\n\n- a\n1. b\n\n> q1\n> q2\n\n"
        "[http://y](http://y)\n\nodd")


def test_few_paragraphs_or_broken_json_are_no_article(one):
    assert _markdown(one, P, P) is None
    assert one(D.paragraphs_markdown("b"), b="{") is None
    assert _markdown(one, *[{"type": "H3", "text": "x"}] * 3) == ""


def test_chapters_by_site(spark):
    long = "A long enough paragraph of the story, number %d."
    page = "<h2>Two</h2><h1>One</h1><div class='x'><p>no</p></div><div class=\"text_story\"><p>Next chapter of something</p></div>" \
           "<div class=\"entry-content\"><p>" + long % 1 + "</p><p>short</p><p>" + long % 2 + "</p></div>"
    rows = [("lightnovelstranslations.com", page), ("webnovel.com", page), ("novelbin.com", '<span class="chr-title">T</span>' + page)]
    found = {r["site"]: r for r in D.read_chapters(spark.createDataFrame(rows, "site string, html string")).collect()}
    light = found["lightnovelstranslations.com"]
    assert (light["title"], light["content"], light["reject"]) == ("Two", long % 1 + "\n\n" + long % 2, None)
    assert found["webnovel.com"]["content"] is None and found["webnovel.com"]["reject"].startswith("text has 0")
    assert found["novelbin.com"]["title"] == "T"


def test_old_chapter_files(spark):
    body = "x" * 60
    rows = [("my_story", "Chapter_0001_a.md", f"---\na: b\n---\n# Head\n\n{body}\n"), ("my_story", "My_Story_Index.md", body),
            ("my_story", "0002 - My Story.md", "# only"), ("my_story", "notes.md", body)]
    found = {r["num"]: r for r in D.convert_old_chapters(spark.createDataFrame(rows, "novel string, name string, content string")).collect()}
    assert set(found) == {1, 2}
    assert found[1]["path"] == "My Story/0001 - My Story.md" and found[1]["content"].endswith(f"---\n\n{body}\n")
    assert found[2]["reject"] == "text has 0 chars (min 50)"


def test_docs_by_site_rules(spark):
    rows = [
        ("aws", "s3/a", '<title>Raw</title><h1 class="big topictitle"> Topic </h1><div id="main-col-body"><p>Body of the page here</p></div>'),
        ("databricks", "x/y", "<title>Page | Databricks</title><article><p>Body of the page here</p></article>"),
        ("claude-code", "en/my-page", "<Note>Body of the page here</Note>"),
        ("soda", "z", "<article><p>tiny</p></article>"), ("none", "q", "<p>x</p>")]
    found = {r["site"]: r for r in docs.read_docs(spark.createDataFrame(rows, "site string, slug string, html string")).collect()}
    assert {s: (r["title"], r["content"], r["reject"]) for s, r in found.items()} == {
        "aws": ("Topic", "Body of the page here", None), "databricks": ("Page", "Body of the page here", None),
        "claude-code": ("My Page", "Body of the page here", None),
        "soda": ("z", "tiny", "Content too short (4 chars) for z"), "none": ("q", "", "unknown site")}


def test_feed_post_falls_back_in_order(spark):
    posts = spark.createDataFrame(
        [("p-00000001", "https://m.com/p-00000001", "<p>%s</p>" % ("stored " * 20)), ("p-00000002", "https://m.com/p-00000002", "<p>x</p>"),
         ("p-00000003", "https://m.com/p-00000003", None), ("p-4", "https://m.com/p-4", None)], "slug string, url string, content_html string")
    lists = spark.createDataFrame([(i, json.dumps([P, P, P])) for i in ("00000001", "00000002")], "post_id string, body string")
    pages = spark.createDataFrame(
        [("https://m.com/p-00000003", "<article><p>%s</p></article>" % ("page " * 30)), ("https://m.com/p-4", "<p>%s</p>" % ("page " * 30))],
        "url string, html string")
    found = {r["slug"]: r["origin"] for r in feeds.read_posts(posts, lists, pages).collect()}
    assert found == {"p-00000001": 0, "p-00000002": 1, "p-00000003": 2, "p-4": None}


def test_transcript_lines(spark, tmp_path):
    videos = spark.createDataFrame([("v", None, "u", "A")], "video_id string, title string, url string, author string")
    parts = spark.createDataFrame(
        [("v", i, f"s{i}") for i in range(1500)] + [("w", 0, "no video")], "video_id string, ord long, text string")
    lines = D.transcript_lines(videos, parts).withColumnRenamed("video_id", "path")
    write_line_files(lines, str(tmp_path), "\n\n")
    assert [p.name for p in tmp_path.iterdir()] == ["v"]
    head = "**Video:** [YouTube Video](u)\n**Channel:** A\n\n## Transcript\n\n"
    assert (tmp_path / "v").read_text() == head + "\n\n".join(f"s{i}" for i in range(1500)) + "\n"
    with pytest.raises(Exception, match="leaves the folder"):
        write_line_files(lines.withColumn("path", F.lit("../x")), str(tmp_path))


def test_chapter_ends_with_its_element_and_falls_to_the_next(spark):
    story = "A long enough paragraph of the story."
    page = (f"<div class='entry-content x'><div><p>{story}</p></div></div><div class=\"comments\"><p>A comment that is long enough too.</p></div>"
            f"<article><p>short</p></article>")
    frame = spark.createDataFrame([(page,)], "html string")
    assert frame.select(D.chapter_text("html", None, (".entry-content", "article")).alias("t")).first()["t"] == story
    assert frame.select(D.chapter_text("html", None, ("#none", "article")).alias("t")).first()["t"] == ""
    rows = spark.createDataFrame([("webnovel.com", "<div class=cha-words><p>x</p></div><div class='cha-content'><p>" + story + "</p></div>")], "site string, html string")
    assert D.read_chapters(rows).first()["content"] == story
