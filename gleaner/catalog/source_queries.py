"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.catalog import inputs as I
from gleaner.catalog.inputs import CHAPTERS_SQL, LEDGER_SQL, table
from gleaner.catalog.registry import query
from gleaner.functions import notes as N
from gleaner.functions import text as T
from gleaner.operators.aggregates import run_summary
from gleaner.operators.offsets import offset_report
from gleaner.session import scratch_path
from gleaner.sources import feeds, links, payloads, sitemaps, tables, trees


@query("s01_read_ledger", "SELECT doc_id, source, lang FROM documents WHERE source = 'src3'")
def s01(spark, d):
    return tables.read_ledger(spark, f"{d}/documents.parquet", "src3", "doc_id long, lang string, source string").select("doc_id", "source", "lang")


_SLOT_SQL = "(SELECT page_id, url, CASE WHEN contains(url, '//blog.') THEN 'blog' ELSE 'news' END AS kind FROM pages)"


@query("s02_sitemap_locs", f"""WITH leaf AS (SELECT DISTINCT kind, page_id // 50 AS slot FROM {_SLOT_SQL}),
 middle AS (SELECT DISTINCT kind, slot // 50 AS slot FROM leaf)
 SELECT 'https://www.example.com/index-' || kind || '-' || (slot // 50) || '.xml' AS parent, 'https://www.example.com/sitemap-' || kind || '-' || slot || '.xml' AS loc FROM leaf
 UNION ALL SELECT 'https://www.example.com/root-' || kind || '-' || (slot // 50) || '.xml', 'https://www.example.com/index-' || kind || '-' || slot || '.xml' FROM middle""")
def s02(spark, d):
    return sitemaps.sitemap_locs(I.sitemap_docs(spark, d)).select("parent", "loc")


@query("s03_sitemap_urls", f"""SELECT 'https://www.example.com/sitemap-' || kind || '-' || (page_id // 50) || '.xml' AS sitemap,
 row_number() OVER (PARTITION BY kind, page_id // 50 ORDER BY page_id) - 1 AS ord, url FROM {_SLOT_SQL}""")
def s03(spark, d):
    return sitemaps.sitemap_urls(I.sitemap_docs(spark, d)).select("sitemap", F.col("ord").cast("long").alias("ord"), "url")


@query("s04_expand_sitemaps", "SELECT url FROM pages WHERE contains(url, '//blog.')")
def s04(spark, d):
    docs = I.sitemap_docs(spark, d)
    roots = docs.filter(F.col("url").contains("/root-"))
    return sitemaps.expand_sitemaps(docs, roots, keywords=["-blog-"]).select("url")


@query("s04_expand_sitemaps_fallback", "SELECT url FROM pages")
def s04_fallback(spark, d):
    """No child matches at the top, so roots keep all; their children then match."""
    docs = I.sitemap_docs(spark, d)
    roots = docs.filter(F.col("url").contains("/root-"))
    return sitemaps.expand_sitemaps(docs, roots, keywords=["/sitemap-"], fallback=True).select("url")


@query("s05_rss_items", r"""SELECT 'user' || (doc_id // 10) AS username, 'post-' || doc_id AS slug, 'https://medium.com/@u/post-' || doc_id || '?source=rss' AS url,
 'Post ' || doc_id AS title, source AS author, 'About ' || lang || ' & more' AS description, '2024-02-03' AS published, '2024-03-04' AS updated,
 lang || ', ' || source AS categories, regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g') AS content FROM documents""")
def s05(spark, d):
    return feeds.rss_items(I.feed_docs(spark, d)).select(
        "username", "slug", "url", "title", "author", "description",
        F.col("publish_date").cast("string").alias("published"), F.col("updated_date").cast("string").alias("updated"),
        F.array_join("categories", ", ").alias("categories"), F.col("content_html").alias("content"))


@query("s06_article_json", """SELECT 'https://example.com/' || doc_id AS url, 'Article ' || doc_id AS title, source AS authors,
 CASE WHEN doc_id % 2 = 0 THEN '2023-01-02' ELSE '2024-02-03' END AS day, 'About ' || lang AS description, '<p>Short</p>' AS summary_html,
 lang || ', ' || source || ', data' AS categories, text AS body_html FROM documents WHERE doc_id % 7 <> 0""")
def s06(spark, d):
    return payloads.article_json(I.article_payloads(spark, d)).select(
        "url", "title", F.array_join("authors", ", ").alias("authors"), F.col("date").cast("string").alias("day"),
        "description", "summary_html", F.array_join("categories", ", ").alias("categories"), "body_html")


@query("s07_glossary_json", r"""SELECT 'https://example.com/' || doc_id AS url, 'Term ' || doc_id AS title, lang AS description,
 array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10)) AS body_html FROM documents""")
def s07(spark, d):
    return payloads.glossary_json(I.glossary_payloads(spark, d)).select("url", "title", "description", "body_html")


@query("s08_page_tree", """SELECT c_custkey AS key, slug, 'https://docs.example.com/en/' || slug AS url, title, parent_path FROM (
 SELECT c_custkey, 'region-' || r_regionkey AS slug, r_name AS title, '' AS parent_path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT c_custkey, 'nation-' || n_nationkey, n_name, 'region-' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT c_custkey, 'customer-' || c_custkey, c_name, 'nation-' || c_nationkey FROM customer
 UNION ALL SELECT c_custkey, 'segment-' || c_custkey, c_mktsegment, 'nation-' || c_nationkey FROM customer)""")
def s08(spark, d):
    """A small tree per customer: region page, folder, nation page, section, two leaf pages."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    rows = (
        table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )

    def node(slug, key, label, children=None, kind="page"):
        parts = [F.lit(kind).alias("type"), label.alias("label")]
        if kind == "page":
            parts.append(F.concat(F.lit(f"/en/{slug}-"), key.cast("string")).alias("href"))
        if children is not None:
            parts.append(children.alias("children"))
        return F.struct(*parts)

    leaves = F.array(
        node("customer", F.col("c_custkey"), F.col("c_name")), node("segment", F.col("c_custkey"), F.col("c_mktsegment")))
    section = node("", F.lit(0), F.lit("Customers"), leaves, kind="section")
    nations = node("nation", F.col("n_nationkey"), F.col("n_name"), F.array(section))
    folder = node("", F.lit(0), F.lit("Nations"), F.array(nations), kind="section")
    tree = node("region", F.col("r_regionkey"), F.col("r_name"), F.array(folder))
    forest = rows.select(F.col("c_custkey").alias("key"), F.to_json(tree).alias("node"))
    return trees.page_tree(forest, "https://docs.example.com").select("key", "slug", "url", "title", "parent_path")


@query("s09_md_links", """SELECT doc_id AS key, 'Title ' || doc_id AS title, 'https://docs.example.com/en/' || lang || '-' || doc_id || '.md' AS url FROM documents""")
def s09(spark, d):
    n = F.col("doc_id").cast("string")
    body = F.concat(
        "text", F.lit("\n- [Title "), n, F.lit("](https://docs.example.com/en/"), "lang", F.lit("-"), n,
        F.lit(".md): about, [Other](https://docs.example.com/fr/x.md) and [No](https://docs.example.com/en/x.html)\n"))
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("key"), body.alias("body"))
    return links.md_links(texts, "https://docs.example.com/en/").select("key", "title", "url")


_NAV_SQL = r"""links AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="/([^"]*)">([^<]*)</a>', 2)) AS word FROM pages)"""


def nav_pages(spark, d):
    """Pages whose navigation links become chapter links of one novel; the page's id is the number."""
    n = F.col("page_id").cast("string")
    html = F.regexp_replace("html", '<li><a href="/', '<li><a href="/novel/story/@chapter-@')
    return table(spark, d, "pages").select(
        F.col("page_id").alias("key"),
        F.replace(html, F.lit("@chapter-@"), F.concat(F.lit("chapter-"), n, F.lit("/"))).alias("html"))


@query("s10_chapter_links", f"WITH {_NAV_SQL} SELECT page_id AS key, page_id AS num, '/novel/story/chapter-' || page_id || '/' || word AS url, word AS title FROM links")
def s10(spark, d):
    return links.chapter_links(nav_pages(spark, d)).select("key", "num", "url", "title")


@query("s10_site_chapters", f"""WITH {_NAV_SQL}, firsts AS (SELECT page_id, list_extract(regexp_extract_all(html, '<li><a href="/([^"]*)">([^<]*)</a>', 2), 1) AS word FROM pages)
 SELECT page_id AS key, page_id AS num, '/novel/story/chapter-' || page_id || '/' || word AS url, word AS title FROM firsts WHERE word IS NOT NULL""")
def s10_site(spark, d):
    return links.site_chapters(nav_pages(spark, d), "lightnovelstranslations.com").select("key", "num", "url", "title")


@query("s11_chapter_sequence", """SELECT conv_id AS key, unnest(generate_series(1, max(turn) + 1)) AS num,
 'https://freewebnovel.com/story-' || conv_id || '/chapter-' || unnest(generate_series(1, max(turn) + 1)) || '.html' AS url,
 'Chapter ' || unnest(generate_series(1, max(turn) + 1)) AS title FROM conversations GROUP BY conv_id""")
def s11(spark, d):
    heads = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("key")).agg((F.max("turn") + 1).alias("max_num"))
    heads = heads.withColumn("slug", F.concat(F.lit("story-"), F.col("key").cast("string")))
    return links.chapter_sequence(heads, "https://freewebnovel.com")


@query("s11_highest_chapter", f"WITH {_NAV_SQL} SELECT page_id AS key, max(page_id) AS max_num FROM links WHERE page_id > 0 GROUP BY page_id")
def s11_highest(spark, d):
    return links.highest_chapter(nav_pages(spark, d))


@query("s12_volume_chapters", """SELECT '' || conv_id || '-' || (turn // 100) AS key, 'c' || turn AS id, turn AS num, CASE WHEN role = 'user' THEN 'Named ' || turn ELSE 'Chapter ' || turn END AS title
 FROM conversations WHERE turn > 0""")
def s12(spark, d):
    """Catalogues of a hundred chapters each; the chapter with index 0 is no chapter."""
    turn = F.col("turn")
    item = F.struct(
        F.concat(F.lit("c"), turn.cast("string")).alias("id"), turn.alias("index"),
        F.when(F.col("role") == "user", F.concat(F.lit("Named "), turn.cast("string"))).alias("name"))
    slot = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.expr("turn div 100").cast("string"))
    docs = table(spark, d, "conversations").groupBy(slot.alias("key")).agg(F.collect_list(item).alias("items"))
    volumes = F.array(F.struct(F.col("items").alias("chapterItems")))
    body = F.to_json(F.struct(F.struct(volumes.alias("volumeItems")).alias("data")))
    return payloads.volume_chapters(docs.select("key", body.alias("body")))


@query("s13_chapter_body_json", r"""SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10) || chr(10)) AS content FROM conversations""")
def s13(spark, d):
    contents = F.transform(F.split("text", "\n"), lambda x: F.struct(F.concat(F.lit(" "), x, F.lit("\t")).alias("content")))
    info = F.struct(F.lit("Chapter").alias("chapterName"), contents.alias("contents"))
    body = F.to_json(F.struct(F.struct(info.alias("chapterInfo")).alias("data")))
    return table(spark, d, "conversations").select("conv_id", "turn", payloads.chapter_body(body).alias("content"))


def bookmark_pages(spark, d):
    """Result pages of fifty bookmarks; one in eleven has no link."""
    n = F.col("event_id")
    item = F.struct(
        (n + 1).alias("_id"),
        F.when(n % 11 != 0, F.concat(F.lit("https://example.com/"), n.cast("string"))).alias("link"),
        F.concat(F.lit("Bookmark "), n.cast("string")).alias("title"), F.lit("example.com").alias("domain"),
        F.col("props").alias("excerpt"), F.array("event_type").alias("tags"), F.lit("link").alias("type"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created"))
    return (
        table(spark, d, "events").groupBy(F.expr("event_id div 50").alias("page"))
        .agg(F.collect_list(item).alias("items"))
        .select(F.to_json(F.struct("items")).alias("body")))


@query("s14_bookmark_items", """SELECT event_id + 1 AS raindrop_id, 'https://example.com/' || event_id AS url, 'Bookmark ' || event_id AS title, props AS excerpt, event_type AS tags,
 strftime(ts, '%Y-%m-%d %H:%M:%S') AS created FROM events WHERE event_id % 11 <> 0""")
def s14(spark, d):
    return payloads.bookmark_items(bookmark_pages(spark, d)).select(
        "raindrop_id", "url", "title", "excerpt", F.array_join("tags", "|").alias("tags"),
        F.date_format("raindrop_created", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("s15_vault_rows", f"WITH {CHAPTERS_SQL} SELECT 'The Story Of ' || novel_id AS novel, num, 'imported' AS site, 'unknown' AS status, true AS in_obsidian FROM chapters")
def s15(spark, d):
    folder = T.folder_name("name")
    files = I.chapters(spark, d).select(
        F.concat(F.lit("/vault/"), folder, F.lit("/"), T.chapter_file(folder, "num")).alias("path"))
    return tables.vault_rows(files).drop("path")


@query("s15_scan_vault", f"WITH {CHAPTERS_SQL} SELECT 'The Story Of ' || novel_id AS novel, num, 'imported' AS site, true AS in_obsidian FROM chapters")
def s15_scan(spark, d):
    """Every chapter's note as a file of a vault, and the vault scanned for its chapters."""
    folder, vault = T.folder_name("name"), scratch_path(spark, "vault")
    notes = I.chapters(spark, d).select(
        F.concat(folder, F.lit("/"), T.chapter_file(folder, "num")).alias("path"), F.col("text").alias("content"))
    tables.write_note_files(notes, vault)
    return tables.scan_vault(spark, vault).select("novel", "num", "site", "in_obsidian")


@query("s16_note_files", "SELECT source || '/' || doc_id || '.md' AS path, coalesce(text, '') AS content FROM documents")
def s16_files(spark, d):
    """Every document as a file of its source's folder, read back whole."""
    notes = table(spark, d, "documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    path = scratch_path(spark, "note-files")
    tables.write_note_files(notes, path)
    return tables.read_note_files(spark, path)


@query("s16_write_notes", "SELECT source, 'notes/' || doc_id || '.md' AS path, '# ' || doc_id || chr(10) || chr(10) || text || chr(10) AS content FROM documents")
def s16(spark, d):
    """Write every document's note by source, then read the table back."""
    n = F.col("doc_id").cast("string")
    notes = table(spark, d, "documents").select(
        "source", N.output_path(F.lit("notes"), n).alias("path"), N.plain_chapter_note(n, F.col("text")).alias("content"))
    path = scratch_path(spark, "notes")
    tables.write_notes(notes, path)
    return spark.read.parquet(path).select("source", "path", "content")


@query("s17_to_json_report", f"""WITH {LEDGER_SQL} SELECT CAST(to_json(struct_pack(id := id, source := source, title := title, status := status, in_obsidian := in_obsidian)) AS VARCHAR) AS json FROM ledger""")
def s17(spark, d):
    return tables.to_json_report(I.ledger(spark, d).select("id", "source", "title", "status", "in_obsidian"))


@query("s18_append_run_log", f"""WITH {LEDGER_SQL} SELECT source, strftime(downloaded_at, '%Y-%m-%d') AS run, count(*) AS total, count(*) FILTER (status = 'downloaded') AS downloaded,
 count(*) FILTER (status = 'failed') AS failed, CASE WHEN count(*) FILTER (status = 'failed') = 0 THEN 'success' ELSE 'partial' END AS status FROM ledger GROUP BY 1, 2""")
def s18(spark, d):
    runs = run_summary(I.ledger(spark, d).withColumn("run", T.day("downloaded_at")), ["source", "run"])
    path = scratch_path(spark, "run-log")
    tables.append_run_log(runs, path)
    return spark.read.parquet(path)


@query("s19_offset_report", """SELECT conv_id AS novel, turn // 100 AS part, '{"novel":"' || conv_id || '","offset_map":{' ||
 string_agg('"' || (turn + 1) || '":' || (turn % 3), ',' ORDER BY turn) || '}}' AS report FROM conversations WHERE role = 'user' GROUP BY 1, 2""")
def s19(spark, d):
    offsets = table(spark, d, "conversations").filter(F.col("role") == "user").select(
        F.col("conv_id").alias("novel"), (F.col("turn") + 1).alias("chapter"), (F.col("turn") % 3).alias("offset"))
    return offset_report(offsets, part=F.expr("(chapter - 1) div 100"))
