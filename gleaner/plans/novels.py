"""Novel runs: check, sync, index and navigation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import values as V
from gleaner.functions import notes as N
from gleaner.functions import text as T
from gleaner.operators.joins import check_updates, join_per_parent, newer_than_local, upsert_fill
from gleaner.operators.ledger import rebuild_index_and_nav
from gleaner.session import written
from gleaner.sources.links import chapter_sequence, highest_chapter, site_chapters
from gleaner.sources.payloads import volume_chapters


def available_chapters(novels: DataFrame, lists: DataFrame) -> DataFrame:
    """``(novel_id, num, url, title)`` that the sites offer, each site read by its own rule.

    ``novels(novel_id, site, slug)``; ``lists(novel_id, body)`` are list pages, or catalogues in JSON.
    """
    of = join_per_parent(lists, novels.select("novel_id", "site", "slug"), ["novel_id"], how="inner").select(
        F.col("novel_id").alias("key"), "site", "slug", F.col("body").alias("html"))
    linked = [site_chapters(of.filter(F.col("site") == site).select("key", "html"), site).select("key", "num", "url", "title")
              for site in (V.NOVEL_SITES[0], V.NOVEL_SITES[2])]
    counted = of.filter(F.col("site") == V.NOVEL_SITES[1])
    tops = highest_chapter(counted.select("key", "html")).groupBy("key").agg(F.max("max_num").alias("max_num"))
    heads = tops.join(novels.select(F.col("novel_id").alias("key"), "slug"), "key")
    catalogued = volume_chapters(of.filter(F.col("site") == V.NOVEL_SITES[3]).select("key", F.col("html").alias("body"))).join(
        novels.select(F.col("novel_id").alias("key"), "slug"), "key")
    address = F.concat(F.lit(f"https://www.{V.NOVEL_SITES[3]}/book/"), "slug", F.lit("/"), "id")
    parts = [*linked, chapter_sequence(heads, f"https://{V.NOVEL_SITES[1]}"), catalogued.select("key", "num", address.alias("url"), "title")]
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("key", "novel_id")


def check_and_sync(
    novels: DataFrame, lists: DataFrame, local: DataFrame, fetched: DataFrame, mode: str = "newer"
) -> dict[str, DataFrame]:
    """``updates`` of all novels by their sites' lists, and what ``sync_chapters`` gives for them."""
    available = written(available_chapters(novels, lists), "available")
    updates = check_updates(novels.select("novel_id", "name"), local, available, "novel_id", "num")
    return {"updates": updates, **sync_chapters(novels.select("novel_id", "name"), available.drop("url"), local, fetched, mode)}


def sync_chapters(
    novels: DataFrame, available: DataFrame, local: DataFrame, fetched: DataFrame, mode: str = "newer"
) -> dict[str, DataFrame]:
    """One sync of all novels.

    ``novels(novel_id, name)``, ``available(novel_id, num, title)``, ``local(novel_id, num,
    title, char_count)`` and ``fetched(novel_id, num, content)`` give the new chapters'
    notes, the new chapter ledger, the run log, and the novels that changed.
    """
    new = newer_than_local(available, local, mode=mode)
    read = new.join(fetched, ["novel_id", "num"], "left").withColumn(
        "char_count", F.when(F.length("content") > V.MIN_CHAPTER, T.char_count("content")))
    good = read.filter(F.col("char_count").isNotNull())
    folder = T.folder_name("name")
    notes = join_per_parent(good, novels, ["novel_id"], ["num"], "inner").select(
        "novel_id", "name", "num", F.concat(folder, F.lit("/"), T.chapter_file(folder, "num")).alias("path"),
        N.chapter_note(folder, T.kebab_case("name"), "num", "content").alias("content"))
    ledger = upsert_fill(local, good, ["novel_id", "num"], ["title", "char_count"])
    failed = F.count_if(F.col("char_count").isNull())
    log = read.groupBy("novel_id").agg(
        F.count(F.lit(1)).alias("new_found"), F.count("char_count").alias("downloaded"),
        F.when(failed == 0, "success").otherwise("partial").alias("status"))
    return {"notes": notes, "ledger": ledger, "log": log, "changed": good.select("novel_id").distinct()}


def refresh_navigation(notes: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Indexes and re-linked notes of the novels that a sync changed."""
    return rebuild_index_and_nav(notes, changed)
