"""The Markdown job: block structure by profile, and the tree helper."""

from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.operators import html_blocks as B
from gleaner.operators import markdown as M


@pytest.fixture
def convert(spark):
    def run(html, profile="article", **options):
        frame = spark.createDataFrame([(html,)], "html string")
        return M.pages_to_markdown(frame, profile, **options).first()["content"]

    return run


@pytest.mark.parametrize("html, expected", [
    ("<h2> A <b>b</b></h2><p>x <b>y</b> <a href='/u'> l </a></p>", "## Ab\n\nx **y** [l](/u)"),
    ("<ol><li>a</li><li> </li><li>c</li></ol>", "1. a\n3. c"),
    ("<ul><li>a <i>b</i></li></ul>", "- a *b*"),
    ("<blockquote> a\n b </blockquote>", "> a\n> b"),
    ('<pre><code class="x language-sql">select\n 1</code></pre>', "```sql\nselect\n 1\n```"),
    ("<pre>raw</pre>", "```\nraw\n```"),
    ('<figure><img src="s" alt="t"><figcaption> c </figcaption></figure>', "![t](s)\n*c*"),
    ("<figure><p>text</p></figure>", "text"),
    ("<div>a<hr>b</div>", "a\n\n---\n\nb"),
    ('<div class="Social">no</div><div class="heading">yes</div>', "yes"),
    ("<nav>no</nav><script>no</script><!-- no --><span>yes</span>", "yes"),
    ("<table><tr><td>a|b</td></tr><tr><td>c</td><td>d</td></tr></table>", "| a\\|b |  |\n| --- | --- |\n| c | d |"),
    ("<p><b>Title<br><p>next</p>", "**Title**\n\nnext"),
    ("", ""),
])
def test_article_profile(convert, html, expected):
    assert convert(html) == expected


def test_null_html_gives_null(convert):
    assert convert(None) is None


def test_substring_class_match(convert):
    html = '<div class="cta-box">no</div><p>yes</p>'
    assert convert(html) == "no\n\nyes"
    assert convert(html, class_match="substring") == "yes"


def test_strict_profile(convert):
    body = "word " * 60
    html = (f'<body><div class="blog-content"><p>{body}</p><img src="data:x"><form>no</form>'
            '<figure><img src="data:y"><figcaption>no</figcaption></figure><p>end</p></div></body>')
    assert convert(html, "strict") == f"{body.strip()} \n\nend"


def test_strict_profile_falls_back_to_body(convert):
    assert convert("<body><article>short</article><p>rest</p></body>", "strict") == "short\n\nrest"


@pytest.mark.parametrize("html, expected", [
    ("<ul><li>a<ol><li>x</li><li>y</li></ol></li><li>b</li></ul>", "- a\n  1. x\n  2. y\n- b"),
    ("<ul><li>a<ul><li>lost</li></ul><ul><li>kept</li></ul></li></ul>", "- a\n  - kept"),
    ("<dl><dt>t</dt><dd>d <b>e</b></dd></dl>", "**t**\n: d **e**"),
    ('<blockquote class="warning">Warning: hot</blockquote>', "> [!WARNING]\n> hot"),
    ("<blockquote>plain</blockquote>", "> plain"),
    ('<div class="toc">no</div><aside>no</aside><header><h1>T</h1></header>', "# T"),
    ('<pre><code class="lang-py">x</code></pre>', "```py\nx\n```"),
])
def test_docs_profile(convert, html, expected):
    assert convert(html, "docs") == expected


def test_cloud_docs_root_and_chrome(convert):
    html = '<body><p>no</p><div id="main-col-body"><div id="breadcrumbs">no</div><div class="prev-next">no</div><p>yes</p></div></body>'
    assert convert(html, "cloud_docs") == "yes"


def test_deep_nesting(convert):
    assert convert("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


class _Standard(HTMLParser):
    """The same events by the standard library's tokenizer: (kind, tag or text, attributes)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.out = [], []

    def _leave(self, depth):
        while len(self.stack) > depth:
            self.out.append((B.END, self.stack.pop(), None))

    def _close(self, tag):
        if tag in self.stack:
            self._leave(len(self.stack) - 1 - self.stack[::-1].index(tag))

    def handle_starttag(self, tag, attrs):
        if tag == "p":
            self._close("p")
        self.out.append((B.START, tag, {k: v or "" for k, v in attrs}))
        self.stack.append(tag)
        if tag in B.VOID:
            self._leave(len(self.stack) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in B.VOID:
            self._close(tag)

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        if not any(t in B.SILENT for t in self.stack):
            self.out.append((B.TEXT, data, None))


def _joined(found):
    """Events with neighbouring texts joined."""
    out = []
    for kind, name, attrs in found:
        if kind == B.TEXT and out and out[-1][0] == B.TEXT:
            out[-1] = (B.TEXT, out[-1][1] + name, None)
        else:
            out.append((kind, name, attrs))
    return out


def _standard(html):
    reader = _Standard()
    reader.feed(html)
    reader.close()
    reader._leave(0)
    return _joined(reader.out)


def _own(html):
    events = B.read_events(html)
    assert all(events.name[c] == n and events.kind[c] == B.END for k, n, c in zip(events.kind, events.name, events.close) if k == B.START)
    return _joined(zip(events.kind, events.name, events.attrs))


def test_events_equal_standard_parser_on_pages(spark, sf_dir):
    for row in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").toLocalIterator():
        assert _own(row["html"]) == _standard(row["html"])


_PIECES = st.sampled_from([
    "<p>", "</p>", "<b>", "</b>", "<div class=\"a b\">", "</div>", "<br>", "<br/>", "<img src='x' alt=y>",
    "text ", "a &amp; b", "<ul><li>", "</li></ul>", "<a href=\"/x?a=1&amp;b=2\" title>", "</a>", "\n", "<H1>", "</H1>",
    "<script>if (a<b) x('</p>');</script>", "<style>p{}</style>", "<!-- c -->",
])


@settings(max_examples=300, deadline=None)
@given(st.lists(_PIECES, max_size=25).map("".join))
def test_events_equal_standard_parser(html):
    assert _own(html) == _standard(html)


def test_unclosed_cells_and_nested_tables(convert):
    assert convert("<table><tr><th>a<th>b<tr><td>c<td>d</table>") == "| a | b |\n| --- | --- |\n| c | d |"
    assert convert("<table><tr><td>x<table><tr><td>in</table></td><td>y</td></tr></table>").count("|") > 6


def test_first_div_with_any_content_class_is_the_root(convert):
    html = "<body><div class='Entry'><p>first</p></div><div class=post-list><p>second</p></div></body>"
    assert convert(html, "article_page") == "first"


def test_body_without_navigation_is_the_last_resort(convert):
    assert convert("<body><aside>no</aside><p>yes</p></body>", "article_page") == "yes"
