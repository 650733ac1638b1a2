"""How the given tables stand in for crawled pages, ledgers, novels and feeds.

Every derivation is a plain projection of a given table, so each query's work grows
with it. The ``*_SQL`` texts are the same derivations for the oracle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ledger row per event: the event's type is the item's outcome."""
    kind, user, event = F.col("event_type"), F.col("user_id"), F.col("event_id")
    status = (
        F.when(kind.isin("click", "purchase"), "downloaded")
        .when(kind == "error", "failed")
        .otherwise("pending")
    )
    source = F.concat(F.lit("site"), (user % 5).cast("string"))
    slug = F.concat(F.lit("item-"), event.cast("string"))
    reason = F.when(event % 3 == 0, "timeout").when(event % 3 == 1, "http_404").otherwise("no_content")
    has_file = (status == "downloaded") & (event % 7 != 0)
    return table(spark, sf_dir, "events").select(
        event.alias("id"),
        source.alias("source"),
        slug.alias("slug"),
        F.concat(F.lit("https://example.com/"), source, F.lit("/"), slug).alias("url"),
        F.when(event % 10 != 0, F.concat(F.lit("Item "), event.cast("string"))).alias("title"),
        F.when(user % 4 == 0, "glossary").otherwise("blog").alias("content_type"),
        F.concat(F.lit("user"), (user % 3).cast("string")).alias("username"),
        status.alias("status"),
        F.when(has_file, F.concat(source, F.lit("/"), slug, F.lit(".md"))).alias("file_path"),
        (kind == "purchase").alias("in_obsidian"),
        F.when(kind == "error", reason).alias("error_reason"),
        F.when(kind == "error", F.concat(F.lit("event "), event.cast("string"))).alias("error_detail"),
        F.when(kind == "error", F.repeat("props", 40)).alias("error_html"),
        F.col("ts").cast("timestamp").alias("downloaded_at"),
        F.col("value"),
    )


LEDGER_SQL = r"""
ledger AS (
  SELECT id, source, slug, 'https://example.com/' || source || '/' || slug AS url,
         CASE WHEN id % 10 <> 0 THEN 'Item ' || id END AS title,
         CASE WHEN user_id % 4 = 0 THEN 'glossary' ELSE 'blog' END AS content_type,
         'user' || (user_id % 3) AS username, status,
         CASE WHEN status = 'downloaded' AND id % 7 <> 0 THEN source || '/' || slug || '.md' END AS file_path,
         kind = 'purchase' AS in_obsidian,
         CASE WHEN kind = 'error' THEN CASE id % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'http_404' ELSE 'no_content' END END AS error_reason,
         CASE WHEN kind = 'error' THEN 'event ' || id END AS error_detail,
         CASE WHEN kind = 'error' THEN repeat(props, 40) END AS error_html,
         ts AS downloaded_at, value
  FROM (SELECT event_id AS id, user_id, event_type AS kind, ts, props, value,
               'site' || (user_id % 5) AS source, 'item-' || event_id AS slug,
               CASE WHEN event_type IN ('click', 'purchase') THEN 'downloaded'
                    WHEN event_type = 'error' THEN 'failed' ELSE 'pending' END AS status
        FROM events))
"""


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as novels: the conversation is the novel, its turns the chapters."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("novel_id"),
        F.concat(F.lit("The story of "), F.col("conv_id").cast("string")).alias("name"),
        (F.col("turn") + 1).alias("num"),
        F.col("role"),
        F.col("text"),
    )


CHAPTERS_SQL = """
chapters AS (
  SELECT conv_id AS novel_id, 'The story of ' || conv_id AS name, turn + 1 AS num, role, text
  FROM conversations)
"""


def post_urls(spark: SparkSession, sf_dir: str, prefix: str) -> DataFrame:
    """Page URLs re-based below a blog prefix: dated, listing, nested, bare and plain ones."""
    url = F.col("url")
    n = F.regexp_extract(url, r"/(\d+)", 1)
    pre = F.lit(prefix)
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(url.contains(".html"), F.concat(pre, F.lit("2020/09/17/post-"), n, F.lit(".html")))
        .when(url.contains("page="), F.concat(pre, F.lit("page/"), n))
        .when(url.endswith("#top"), F.concat(pre, F.lit("a/b-"), n))
        .when(url.endswith("/"), pre)
        .otherwise(F.concat(pre, F.lit("post-"), n, F.lit("/")))
        .alias("url"),
    )


def post_urls_sql(prefix: str) -> str:
    return rf"""
posts AS (
  SELECT page_id, CASE
    WHEN url LIKE '%.html%' THEN '{prefix}2020/09/17/post-' || n || '.html'
    WHEN url LIKE '%page=%' THEN '{prefix}page/' || n
    WHEN url LIKE '%#top' THEN '{prefix}a/b-' || n
    WHEN url LIKE '%/' THEN '{prefix}'
    ELSE '{prefix}post-' || n || '/' END AS url
  FROM (SELECT page_id, url, regexp_extract(url, '/(\d+)', 1) AS n FROM pages))
"""


def _xml(text):
    """Escape a text for XML."""
    result = F.replace(text, F.lit("&"), F.lit("&amp;"))
    result = F.replace(result, F.lit("<"), F.lit("&lt;"))
    return F.regexp_replace(result, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


_SITEMAP_NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def sitemap_docs(spark: SparkSession, sf_dir: str, post_prefix: str | None = None, post_name: str = "post-") -> DataFrame:
    """Three levels of sitemap documents over the page URLs, or over posts (two pages each).

    Sitemaps have a bounded number of entries (as the format demands), so a group
    is a slice of the page ids, never a whole host.
    """
    base = "https://www.example.com/"
    kind = F.when(F.col("url").contains("//blog."), "blog").otherwise("news")
    loc = F.col("url")
    if post_prefix:
        loc = F.concat(F.lit(post_prefix + post_name), F.expr("page_id div 2").cast("string"))
    entry = F.concat(F.lit("<url><loc> "), _xml(loc), F.lit(" </loc></url>"))
    urlsets = (
        table(spark, sf_dir, "pages")
        .select(kind.alias("kind"), F.expr("page_id div 50").alias("slot"), "page_id", entry.alias("entry"))
        .groupBy("kind", "slot").agg(F.sort_array(F.collect_list(F.struct("page_id", "entry"))).alias("e"))
        .select(
            "kind", "slot",
            F.concat(F.lit(base + "sitemap-"), "kind", F.lit("-"), F.col("slot").cast("string"), F.lit(".xml")).alias("url"),
            F.concat(F.lit(f"<urlset {_SITEMAP_NS}>"), F.array_join(F.col("e.entry"), ""), F.lit("</urlset>")).alias("body"),
        )
    )

    def index(children: DataFrame, name: str) -> DataFrame:
        loc = F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>"))
        return (
            children.select("kind", F.expr("slot div 50").alias("slot"), loc.alias("loc"))
            .groupBy("kind", "slot").agg(F.sort_array(F.collect_list("loc")).alias("locs"))
            .select(
                "kind", "slot",
                F.concat(F.lit(f"{base}{name}-"), "kind", F.lit("-"), F.col("slot").cast("string"), F.lit(".xml")).alias("url"),
                F.concat(F.lit(f"<sitemapindex {_SITEMAP_NS}>"), F.array_join("locs", ""), F.lit("</sitemapindex>")).alias("body"),
            )
        )

    middle = index(urlsets, "index")
    top = index(middle, "root")
    return reduce(DataFrame.unionByName, [urlsets, middle, top]).select("url", "body")


def feed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of ten documents each."""
    n = F.col("doc_id").cast("string")
    clean = F.regexp_replace("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    item = F.concat(
        F.lit("<item><title><![CDATA[ Post "), n, F.lit("]]></title><link>https://medium.com/@u/post-"), n,
        F.lit("?source=rss</link><dc:creator><![CDATA["), "source",
        F.lit("]]></dc:creator><description><![CDATA[<p>About <b>"), "lang",
        F.lit("</b> &amp; more</p>]]></description><pubDate>Sat, 03 Feb 2024 10:20:30 GMT</pubDate>"
              "<atom:updated>2024-03-04T05:06:07Z</atom:updated><category>"), "lang",
        F.lit("</category><category>"), "source",
        F.lit("</category><content:encoded><![CDATA["), clean, F.lit("]]></content:encoded></item>"))
    head = ('<rss xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:atom="http://www.w3.org/2005/Atom" '
            'xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>Feed</title>')
    return (
        table(spark, sf_dir, "documents")
        .select(F.expr("doc_id div 10").alias("feed"), F.struct("doc_id", item.alias("item")).alias("e"))
        .groupBy("feed").agg(F.sort_array(F.collect_list("e")).alias("e"))
        .select(
            F.concat(F.lit("user"), F.col("feed").cast("string")).alias("username"),
            F.concat(F.lit(head), F.array_join("e.item", ""), F.lit("</channel></rss>")).alias("body"))
    )


def article_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article payload per document; every seventh has no body."""
    n = F.col("doc_id")

    def named(*names):
        return F.array(*[F.struct(F.struct(x.alias("name")).alias("entity")) for x in names])

    article = F.struct(
        F.concat(F.lit("Article "), n.cast("string")).alias("title"),
        named(F.col("source"), F.lit("")).alias("fieldAuthors"),
        F.when(n % 2 == 0, "").otherwise("2024-02-03T04:05:06").alias("entityCreatedRaw"),
        F.lit("2023-01-02").alias("fieldDate"),
        F.array(
            F.struct(F.lit("title").alias("key"), F.lit("t").alias("value")),
            F.struct(F.lit("description").alias("key"), F.concat(F.lit("About "), "lang").alias("value")),
        ).alias("entityMetatags"),
        F.struct(F.lit("<p>Short</p>").alias("processed")).alias("fieldAiSummary"),
        named(F.col("lang")).alias("fieldCategories"),
        named(F.col("lang"), F.col("source"), F.lit("data")).alias("fieldTags"),
        F.struct(F.when(n % 7 == 0, "").otherwise(F.col("text")).alias("processed")).alias("body"),
    )
    nested = F.struct(F.struct(F.struct(article.alias("article")).alias("drupal")).alias("data")).alias("result")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("https://example.com/"), n.cast("string")).alias("url"), F.to_json(F.struct(nested)).alias("body"))


def glossary_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One glossary payload per document; its lines are the components."""
    component = F.transform(
        F.split("text", "\n"),
        lambda x: F.struct(F.struct(F.struct(x.alias("processed")).alias("fieldBody")).alias("entity")))
    page = F.struct(
        F.concat(F.lit("Term "), F.col("doc_id").cast("string")).alias("title"),
        F.array(F.struct(F.lit("description").alias("key"), F.col("lang").alias("value"))).alias("entityMetatags"),
        component.alias("fieldComponents"))
    nested = F.struct(F.struct(F.struct(page.alias("glossaryPage")).alias("drupal")).alias("data")).alias("result")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string")).alias("url"),
        F.to_json(F.struct(nested)).alias("body"))
