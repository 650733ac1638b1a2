"""Joins between discovered entries, ledgers and parents.

Keys of a ledger are unique, so its joins meet no hot key once the other side is
reduced to one row per key. Where a table of children joins one row per parent, a
parent may own a large share of all children: ``join_per_parent`` finds and spreads it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import values as V
from gleaner.functions import text as T
from gleaner.functions import urls as U
from gleaner.operators.sequences import dedup_first, fetch_rows, first_rows
from gleaner.session import written

#: Keys that the sketch of heavy hitters follows; its counts are off by a ten-thousandth of all rows or so.
TRACKED = 20_000
#: Slots of a hot key, per partition that its rows would fill: slots fall into tasks by hash, many of them evenly.
SLOTS_PER_PARTITION = 32


def heavy_hitters(rows: DataFrame, keys: list[str]) -> list[tuple[int, int]]:
    """``(hash, slots)`` of the keys that hold over half a shuffle partition's share of all rows.

    One pass over the key columns with a sketch of bounded size; two keys a partition at most can be hot.
    Hashes stand for keys: a collision spreads a second key for nothing.
    """
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = rows.select(F.xxhash64(*keys).alias("h"))
    most = min(2 * partitions, TRACKED)
    seen = hashed.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {most}, {max(TRACKED, most)})").alias("top")).first()
    return [(t["item"], math.ceil(SLOTS_PER_PARTITION * t["count"] * partitions / seen.n))
            for t in seen.top or [] if 2 * t["count"] * partitions > seen.n]


def join_per_parent(
    children: DataFrame, parents: DataFrame, keys: list[str], spread_by: list[str] | None = None, how: str = "left"
) -> DataFrame:
    """Join children to one row per parent; the children of a hot parent go to as many tasks as their share asks for.

    Hot parents are found before (``heavy_hitters``); without any, this is a plain join. The slot of a hot
    parent's child comes from the child's own values (all columns by default), so a task that runs again
    puts each row into the same slot. Only hot parents are repeated, once per slot.
    """
    hot = heavy_hitters(children, keys)
    if not hot:
        return children.join(parents, keys, how)
    # two rows a partition at most
    slots = F.broadcast(children.sparkSession.createDataFrame(hot, "_hash long, _slots int"))
    alike = [F.col(k).try_cast(children.schema[k].dataType) for k in keys]  # equal keys of other types hash differently
    spread = children.withColumn("_hash", F.xxhash64(*keys)).join(slots, "_hash", "left").withColumn(
        "_slot", F.when(F.col("_slots").isNull(), 0).otherwise(F.pmod(F.xxhash64(*(spread_by or children.columns)), F.col("_slots"))).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_slots", F.lit(1)) - 1))
    repeated = parents.withColumn("_hash", F.xxhash64(*alike)).join(slots, "_hash", "left").withColumn("_slot", every)
    return spread.drop("_hash", "_slots").join(repeated.drop("_hash", "_slots"), keys + ["_slot"], how).drop("_slot")


def list_with_counts(parents: DataFrame, children: DataFrame, key: str, num: str) -> DataFrame:
    """Every parent with its highest child number and its number of children, by name.

    Children are counted before the join: one row per parent meets the parents.
    """
    counts = children.groupBy(key).agg(F.max(num).alias("latest"), F.count(num).alias("count"))
    return parents.join(counts, key, "left").select(
        *parents.columns,
        F.coalesce("latest", F.lit(0)).alias("latest"),
        F.coalesce("count", F.lit(0)).alias("count"),
    ).orderBy("name")


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the left side whose key the right side does not hold; keys are unique on each side."""
    return left.join(right.select(*keys), keys, "left_anti")


def discover_new(entries: DataFrame, ledger: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Entries not in the ledger, first of each key, as pending rows.

    Only keys, orders and row numbers meet the ledger; other columns are fetched for the new rows.
    """
    if set(entries.columns) <= {*keys, *order}:
        fresh = difference(dedup_first(entries, keys, order), ledger, keys)
    else:
        rows, first = first_rows(entries, keys, order)
        fresh = fetch_rows(rows, difference(first, ledger, keys))
    return fresh.withColumn("status", F.lit(V.PENDING))


def upsert_fill(
    base: DataFrame, incoming: DataFrame, keys: list[str], columns: list[str], order: str | None = None
) -> DataFrame:
    """Insert new keys; on known ones a value that is present replaces the old one.

    With ``order``, an incoming key may repeat: the last present value of each column counts.
    """
    if order:
        incoming = incoming.groupBy(*keys).agg(
            *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])
    old, new = base.select(*keys, *columns).alias("old"), incoming.select(*keys, *columns).alias("new")
    return old.join(new, keys, "full_outer").select(
        *keys, *[F.coalesce(f"new.{c}", f"old.{c}").alias(c) for c in columns])


def mark_moved(ledger: DataFrame, moved: DataFrame, keys: list[str], moved_at: Column) -> DataFrame:
    """Flag the rows whose key was moved and set their time; all others stay."""
    flags = moved.select(*keys).distinct().withColumn("_moved", F.lit(True))
    hit = F.col("_moved").isNotNull()
    old = F.col("moved_at") if "moved_at" in ledger.columns else F.lit(None).cast("timestamp")
    return ledger.join(flags, keys, "left").withColumns({
        "in_obsidian": F.when(hit, True).otherwise(F.col("in_obsidian")),
        "moved_at": F.when(hit, moved_at).otherwise(old),
    }).drop("_moved")


def newer_than_local(
    available: DataFrame, local: DataFrame, parent: str = "novel_id", num: str = "num", mode: str = "newer"
) -> DataFrame:
    """Available rows above the parent's highest local number; ``missing`` also fills gaps."""
    if mode == "missing":
        return difference(available, local, [parent, num])
    highest = local.groupBy(parent).agg(F.max(num).alias("_high"))
    joined = join_per_parent(available, highest, [parent], [parent, num])
    return joined.filter(F.col(num) > F.coalesce("_high", F.lit(0))).drop("_high")


def first_success(items: DataFrame, key: str, *sources: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``items`` (unique keys) with ``content`` and ``origin`` of the first source that has usable content.

    Each source takes the items that no earlier one served and gives ``(key, content)`` after its own gate;
    null content is no success, and of several contents for one key the one that sorts first counts. What a
    source served is written once, so a later source reads and converts the misses only.
    """
    served: list[DataFrame] = []
    for rank, source in enumerate(sources):
        missing = reduce(lambda rows, hits: rows.join(hits.select(key), key, "left_anti"), served, items)
        found = source(missing).where(F.col("content").isNotNull()).groupBy(key).agg(F.min("content").alias("content"))
        served.append(written(found.withColumn("origin", F.lit(rank)), f"served-{rank}"))
    return items.join(reduce(DataFrame.unionByName, served), key, "left")


def route_items(
    bookmarks: DataFrame, other_ledger: DataFrame, route: bool = True
) -> tuple[DataFrame, DataFrame]:
    """``(bookmarks, routed)``: rows of the other family leave as new rows of its ledger.

    Routed bookmarks stay in their own ledger, marked as skipped.
    """
    marked = bookmarks.withColumn("family", U.url_family("url") if route else F.lit("web"))
    medium = F.col("family") == "medium"
    kept = marked.withColumns({
        "status": F.when(medium, V.SKIPPED_MEDIUM).otherwise(V.PENDING),
        "routed_to": F.when(medium, "medium"),
    })
    entries = marked.filter(medium).select(
        U.slug_page_name("url").alias("slug"), U.username_of("url").alias("username"),
        "url", "title", "raindrop_id",
    ).filter(F.col("slug").isNotNull())
    return kept, discover_new(entries, other_ledger, ["slug"], ["raindrop_id"])


def supplement(primary: DataFrame, extra: DataFrame, suffix: str = ".md") -> DataFrame:
    """Primary entries, then extra ones whose URL without the suffix is not among them, each such URL once.

    Of several extra entries for one URL the one that sorts first stays.
    """
    pattern = F.regexp_replace("url", suffix.replace(".", r"\.") + "$", "")
    known = primary.select(pattern.alias("_canonical")).distinct()
    once = dedup_first(extra.withColumn("_canonical", pattern), ["_canonical"], ["url"])
    fresh = once.join(known, "_canonical", "left_anti")
    return primary.unionByName(fresh.drop("_canonical"), allowMissingColumns=True)


def remove_parents(frame: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Rows of a parent, child or log table without those of the removed parents."""
    return join_per_parent(frame, removed.select(key).distinct(), [key], how="left_anti")


def check_updates(parents: DataFrame, local: DataFrame, available: DataFrame, key: str, num: str) -> DataFrame:
    """Per parent: highest local and available number, how many are new."""
    have = local.groupBy(key).agg(F.max(num).alias("local"))
    offer = available.groupBy(key).agg(F.max(num).alias("available"))
    joined = parents.join(have, key, "left").join(offer, key, "left")
    mine, theirs = F.coalesce("local", F.lit(0)), F.coalesce("available", F.lit(0))
    return joined.select(
        *parents.columns, mine.alias("local"), theirs.alias("available"), T.new_items(theirs, mine).alias("new"))


def resolve_short_links(items: DataFrame, redirects: DataFrame) -> DataFrame:
    """Add ``resolved``: the redirect's target for short links that lead to another site.

    Only short links go through the join; all other rows pass by without a shuffle.
    """
    short = U.is_short_link("url")
    plain = items.filter(~short).withColumn("resolved", F.col("url"))
    leads_out = (U.host("final_url") != "") & ~U.is_short_link("final_url")
    targets = redirects.filter(U.is_short_link("url") & leads_out).groupBy("url").agg(F.min("final_url").alias("final_url"))
    linked = join_per_parent(items.filter(short), targets, ["url"]).withColumn(
        "resolved", F.coalesce("final_url", "url")).drop("final_url")
    return plain.unionByName(linked)
