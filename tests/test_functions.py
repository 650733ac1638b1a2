"""Scalar functions on small hand-written inputs."""

import datetime
import html

import pytest
from pyspark.sql import functions as F

from gleaner.functions import html as H
from gleaner.functions import notes as N
from gleaner.functions import text as T
from gleaner.functions import urls as U


@pytest.mark.parametrize("title, expected", [
    ("Data Mesh: Part II of III", ("Data Mesh", 2)),
    ("Data Mesh Part iv of five", ("Data Mesh", 4)),
    ("Data Mesh - Part IX", ("Data Mesh", 9)),
    ("Data Mesh — Part 12 of 30", ("Data Mesh", 12)),
    ("Data Mesh (Part 3)", ("Data Mesh", 3)),
    ("Data Mesh (Part X)", ("Data Mesh", 10)),
    ("  Data Mesh: Part 2  ", ("Data Mesh", 2)),
    ("Data Mesh - Part IIIV", None),
    ("Data Mesh Part 3", None),
    ("Party time", None),
    ("", None),
])
def test_series_part(one, title, expected):
    found = one(T.series_part("t"), t=title)
    assert (tuple(found) if found else None) == expected


@pytest.mark.parametrize("text, expected", [
    ("Tue, 03 Jun 2025 23:30:00 -0700", datetime.date(2025, 6, 3)),
    ("3 Jun 2025 01:02:03 GMT", datetime.date(2025, 6, 3)),
    ("2025-06-03T01:02:03Z", datetime.date(2025, 6, 3)),
    ("soon", None),
])
def test_rfc2822_date(one, text, expected):
    assert one(T.rfc2822_date("t"), t=text) == expected


@pytest.mark.parametrize("url, expected", [
    ("https://www.databricks.com/blog/2020/09/17/some-slug.html", "2020-09-17-some-slug"),
    ("https://www.databricks.com/blog/2020/09/17/some/slug", "2020-09-17-some/slug"),
    ("https://www.databricks.com/blog/some-slug/", "some-slug"),
    ("https://www.databricks.com/blog/category/x", None),
    ("https://www.databricks.com/blog/a/b", None),
    ("https://www.databricks.com/blog/", None),
])
def test_slug_dated(one, url, expected):
    assert one(U.slug_dated("u"), u=url) == expected


@pytest.mark.parametrize("url, expected", [
    ("https://www.snowflake.com/blog/post", True),
    ("https://www.snowflake.com/en/blog/post/", True),
    ("https://www.snowflake.com/blog/page/2", False),
    ("https://www.snowflake.com/blog/pages", True),
    ("https://www.snowflake.com/blog/12/", False),
    ("https://www.snowflake.com/blog/", False),
    ("https://elsewhere.com/blog/post", False),
])
def test_is_blog_url(one, url, expected):
    assert one(U.is_blog_url("u"), u=url) is expected


@pytest.mark.parametrize("url, site, expected", [
    ("https://lightnovelstranslations.com/novel/my-story/?tab=x", "lightnovelstranslations.com", "my-story"),
    ("https://freewebnovel.com/my-story.html", "freewebnovel.com", "my-story"),
    ("https://freewebnovel.com/my-story/chapter-4.html/", "freewebnovel.com", "my-story"),
    ("https://novelbin.com/b/my-story/x", "novelbin.com", "my-story"),
    ("https://www.webnovel.com/book/my-story_123", "webnovel.com", "123"),
    ("https://other.com/x", "other.com", None),
])
def test_novel_slug(one, url, site, expected):
    assert one(U.novel_slug("u", "s"), u=url, s=site) == expected


@pytest.mark.parametrize("url, expected", [
    ("https://youtu.be/abc", "abc"),
    ("https://www.youtube.com/watch?x=1&v=a%2Db", "a-b"),
    ("https://youtube.com/shorts/abc/", "abc"),
    ("https://youtube.com/v/abc/more", "abc"),
    ("https://youtube.com/channel/abc", None),
])
def test_video_id(one, url, expected):
    assert one(U.video_id("u"), u=url) == expected


@pytest.mark.parametrize("url, expected", [
    ("https://user:pw@Medium.com:443/x", "medium"),
    ("http://notmedium.com/x", "web"),
    ("https://itnext.io/x", "medium"),
    ("https://www.itnext.io/x", "web"),
    ("https://youtu.be/x", "youtube"),
    ("no url", "web"),
])
def test_url_family(one, url, expected):
    assert one(U.url_family("u"), u=url) == expected


def test_chapter_names(one):
    assert one(T.chapter_file("f", "n"), f="My Novel", n=12345) == "12345 - My Novel.md"
    assert one(T.chapter_file("f", "n"), f="My Novel", n=7) == "0007 - My Novel.md"
    assert one(T.index_link("f"), f="My Novel") == "My Novel_Index".replace(" ", "_")
    assert one(T.folder_name("f"), f=' the  "dragon\'s" egg? ') == "The Dragon's Egg"


@pytest.mark.parametrize("title, expected", [
    ("Story - Chapter 7: Dawn | Site", "Chapter 7: Dawn"),
    ("my story - Chapters of old | Site", "Chapters of old"),
    ("My Story - Chapters of old | Site", "Chapters of old"),
    ("Front page", "Chapter 9"),
])
def test_chapter_title(one, title, expected):
    assert one(T.chapter_title("t", "n", "k"), t=title, n="my story", k=9) == expected


def test_front_matter_removal(one):
    text = "---\ntags:\n  - x\n---\n\nintro\n# Head\nbody\n# Other"
    assert one(T.drop_first_heading(T.strip_front_matter("t")), t=text) == "intro\nbody\n# Other"
    assert one(T.strip_front_matter("t"), t="--- only") == "--- only"
    assert one(T.drop_first_heading("t"), t="# all") == ""
    assert one(T.drop_first_heading("t"), t="no head\n") == "no head"


def test_nav_footer_is_idempotent(one):
    footer = N.nav_footer(F.lit("My Novel"), F.lit(1), F.lit(3))
    once = one(N.with_nav("t", footer), t="Body\n\n")
    assert once == (
        "Body\n\n---\n\n<!-- nav-footer -->\n[[0001 - My Novel|← Ch 1]] | [[My_Novel_Index|Index]] | "
        "[[0003 - My Novel|Ch 3 →]]\n")
    assert one(N.with_nav("t", footer), t=once) == once


def test_series_nav_is_idempotent(one):
    block = N.series_nav(F.lit('A: "x"'), F.lit(None).cast("string"))
    once = one(N.with_series_nav("t", block), t="Body \n")
    assert once == "Body\n---\n\n**Series Navigation**\n\n- ← Previous: [[A x]]\n"
    assert one(N.with_series_nav("t", block), t=once) == once


def test_front_matter_omits_absent_parts(one):
    head = N.front_matter(
        F.lit('A "b"'), F.lit("u"), F.lit("2024-05-06"), F.array(F.lit("x")), F.array().cast("array<string>"),
        F.lit(None).cast("date"), F.lit(""))
    assert one(head) == '---\ntitle: "A \\"b\\""\nsource: "u"\ncreated: 2024-05-06\ntags:\n  - "x"\n---'


def test_unescape_and_text(one):
    assert one(H.visible_text("t"), t=" <p>a &amp;lt; b&#233;&#128512;</p> ") == "a &lt; bé😀"
    assert one(H.visible_text("t"), t="plain") == "plain"


def test_tags(one):
    assert one(T.parse_tags("t"), t='["a","b"]') == ["a", "b"]
    assert one(T.parse_tags("t"), t="{") == []
    merged = T.merge_tags(F.array(F.lit("a")), F.array(F.lit("b"), F.lit("a"), F.lit("b")))
    assert one(merged) == ["a", "b", "b"]


def test_novel_status_needs_whole_words(one):
    assert one(T.novel_status("t"), t="An incomplete tale") == "ongoing"
    assert one(T.novel_status("t"), t="Complete!") == "completed"


def test_remove_chrome(one):
    html = '<div id="toc">x</div><p class="a">k</p><div class="big ad">y</div><div class="adx">z</div><NAV a="1">n\n</nav>'
    assert one(H.remove_chrome("t", ids=("toc",), classes=("ad",)), t=html) == '<p class="a">k</p><div class="adx">z</div>'


def test_page_meta_order(one):
    html = ('<title>T | Snowflake Blog</title><meta name="og:title" content=" Og &amp; x "><h1>H</h1>'
            '<meta content="Ann" name="author"><time datetime="2024-01-02T00:00">x</time>')
    found = one(H.page_meta("t"), t=html)
    assert (found["title"], found["authors"], found["date"]) == ("Og & x", ["Ann"], datetime.date(2024, 1, 2))
    assert one(H.page_meta("t"), t="<title>T – Snowflake Inc</title>")["title"] == "T"


def test_json_ld_first_script_with_data(one):
    html = ('<script type="application/ld+json">{"name": 1}</script>'
            '<script type="application/ld+json">[{"datePublished": "2024-01-02T", "author": [{"name": "A"}, {"name": ""}]}]</script>'
            '<script type="application/ld+json">{"author": {"name": "B"}}</script>')
    found = one(H.json_ld("t"), t=html)
    assert (found["date"], found["authors"]) == (datetime.date(2024, 1, 2), ["A"])


def test_inline_markdown(one):
    html = 'a <b> x </b><i></i> <a href="/u">l</a><br>z <code>c</code><img src="s" alt="t"> <u>q</u>'
    assert one(H.inline_markdown("t"), t=html) == "a **x** [l](/u)\nz `c`![t](s) q"


def test_table_pads_and_escapes(one):
    html = "<table><tr><th>A</th><th>B</th></tr><tr><td>x|y</td></tr><tr></tr></table>"
    assert one(H.table_markdown("t"), t=html) == "| A | B |\n| --- | --- |\n| x\\|y |  |"


def test_nested_chrome_ends_with_its_own_end_tag(one):
    def cut(html, **names):
        return one(H.remove_chrome("x", names.get("tags", ()), names.get("ids", ()), names.get("classes", ())), x=html)

    assert cut('a<div class="ad"><div><DIV>1</DIV></div>2<div/>3</div>b<div>c</div>', classes=("ad",)) == "ab<div>c</div>"
    assert cut("<nav><ul><nav>x</nav></ul></nav>y<nav>z</nav>", tags=("nav",)) == "y"
    assert cut('<p id=k>1<div id="k">2<p>3</p></div></p>4', ids=("k",)) == "4"
    assert cut('<div class="side"><span>never ends<div></div>', classes=("side",)) == '<div class="side"><span>never ends<div></div>'
    assert cut('1<i class="ad">2<div class="ad">3</i>4</div>5', classes=("ad",)) == "15"
    assert cut("no tags < here", tags=("nav",)) == "no tags < here" and cut("", tags=("nav",)) == ""
    assert one(H.remove_chrome(F.lit(None).cast("string"), ("nav",))) is None
    deep = "<div>" * 300
    assert cut(f'<div class="ad">{deep}x{"</div>" * 300}</div>y', classes=("ad",)) == "y"


def test_mdx_clean(one):
    text = "<Tip>\n a\n b\n</Tip>\n<Warning>open\n<Tabs><Tab title=\"One\">x</Tab></Tabs>\n<br>"
    assert one(H.mdx_clean("t"), t=text) == "> [!TIP]\n> a\n>  b\nopen\n#### One\n\nx\n<br>"


def test_callouts(one):
    assert one(H.callout_type("c", "t"), c="x-danger", t="abc") == "WARNING"
    assert one(H.callout_type("c", "t"), c="", t="Hint: abc") == "TIP"
    assert one(H.callout_type("c", "t"), c="", t="Notes abc") is None
    assert one(H.callout_body("t"), t="Note:: abc") == "abc"


@pytest.mark.parametrize("text", [
    "a &amp; b", "&#x2019;&rarr;&#38;lt;", "&#8217;&nbsp;&NotEqualTilde;", "&copyright; &amp", "&unknown; &", "&#0;&#xD800;&#99999999999999999999;",
    "&#150;", "&lt;b&gt;", "x&eacute", "&#1114112;",
])
def test_entities_as_the_standard_library_has_them(one, text):
    assert one(H.unescape("x"), x=text) == html.unescape(text)


def test_attributes_in_any_quotes(one):
    page = "<meta name='author' content=\"O'Hara\"><meta property=og:title content=T><a class=x href=/a>one</a><a href='/b' title='B &gt; c'>two</a>"
    tags = one(H.metas("x"), x=page)
    assert [(t["property"], t["name"], t["content"]) for t in tags] == [("", "author", "O'Hara"), ("og:title", "", "T")]
    links = one(H.anchors("x"), x=page)
    assert [(a["href"], a["text"]) for a in links] == [("/a", "one"), ("/b", "two")] and links[1]["title"] == "B &gt; c"
    assert one(H.class_text("x", "date"), x="<p class='a date b'>D</p>") == one(H.class_text("x", "date"), x="<p class=date>D</p>") == "D"
    assert one(H.inline_markdown("x"), x="<a href='/u'>l</a> <img alt='A' src=/i.png><img src='/j.png'>") == "[l](/u) ![A](/i.png)![](/j.png)"
    assert one(H.table_rows("x"), x="<table><tr><th>a<th>b<tr><td>c</td><td>d</table>") == [["a", "b"], ["c", "d"]]
    assert one(H.json_ld("x"), x="<script type='application/ld+json'>{\"author\":{\"name\":\"N\"}}</script>")["authors"] == ["N"]
    assert one(H.remove_chrome("x", (), ("i",), ("ad",)), x="<p id=i>x</p><div class='ad b'>y</div>z") == "z"
