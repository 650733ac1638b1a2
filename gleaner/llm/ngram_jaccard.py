"""N-gram Jaccard join by PartEnum signatures.

Documents are sets of word n-grams; two link when their Jaccard similarity reaches a threshold.
Sets fall into size bands whose limits stand in the ratio of the threshold, so that a similar pair
lies in one band or in two neighbouring ones. Inside a band the threshold bounds the symmetric
difference by some k. The feature domain is cut into ``n1`` parts, each into ``n2`` smaller ones;
at most ``k // (k2 + 1)`` parts can hold more than ``k2`` differences, so a similar pair agrees on
some ``n2 - k2`` of the smaller parts of one part: one signature for each such subset.

A signature over an empty selection, or over one element, says little, yet all sets with that gap or
with that frequent element would share it. Those of one element are left out where the counting argument
holds without them; empty ones are left out too, and a set with too many gaps for that repeats the
enumeration over another cut of the domain (both of two such sets do), and only after ``ROUNDS`` cuts keeps all.

Inside a bucket of equal signatures each member is a candidate with the first one only. Candidates
are verified on the sets; before that, parity sketches (one bit a hash value, each element flips its
bit) rule out pairs whose sketches differ in more bits than the sets may differ in elements. Buckets
whose members end in more than one component are then searched in full: the members outside the
bucket's largest component against all others, in blocks, by their sketches, and what passes is
verified. So no link is lost, and no bucket is expanded into all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import sys
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import staged
from gleaner.llm.components import connected_components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cuts of the domain to try before signatures of empty selections are kept.
ROUNDS = 4
#: Elements that a signature should cover, where enough of them do.
LEAST_COVER = 2
#: Members of one side of a block comparison, and rows of comparisons that one task takes at a time.
BLOCK_ROWS = 2000
BIN_ROWS = 20_000
#: Bits a node of the filter before the join of texts, bits of one of Spark's bitmaps, and most bitmaps (32 MB).
FILTER_BITS = 32
BLOCK_BITS = 32_768
MOST_BLOCKS = 8192
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63,
        0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text, letters A-Z lowered.

    Words stand between ASCII white space. With fewer than n words the whole sequence is the one
    n-gram; without words the set is empty.
    """
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = mix(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    width = min(n, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        total = mix(total + h[i: len(words) - width + 1 + i] * np.uint64(_ODD[i % 8] + 2 * (i // 8)))
    return np.unique(total)


class Bands:
    """Size bands and the enumeration of each, for a threshold ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.tops: list[int] = []

    def band(self, size: int) -> int:
        """Index of the band of a set size: each band ends at the largest size that can link with its first."""
        while not self.tops or self.tops[-1] < size:
            first = self.tops[-1] + 1 if self.tops else 1
            self.tops.append(max(first, first * self.den // self.num))
        return int(np.searchsorted(self.tops, size))

    def plan(self, band: int) -> tuple[int, int, int, int, np.ndarray]:
        """k, n1, n2, k2 and the subsets (as 0/1 rows over n2) that serve sets of this band and the one below."""
        self.band(1)
        while len(self.tops) <= band:
            self.band(self.tops[-1] + 1)
        k = 2 * self.tops[band] * (self.den - self.num) // (self.den + self.num)
        if k == 0:
            return 0, 1, 1, 0, np.ones((1, 1), np.uint64)
        # parts to spare, for sets with gaps; large sets have enough elements a part without a second cut
        if k > 24:
            return k, k + 1 + k // 6 + 2, 1, 0, np.ones((1, 1), np.uint64)
        k2, n2 = 1, 4 if k <= 8 else 3
        n1 = k // (k2 + 1) + 1
        n1 += (n1 + 9) // 10 if k > 2 else 0
        picks = np.zeros((n2, n2), np.uint64)
        for row, chosen in enumerate(combinations(range(n2), n2 - k2)):
            picks[row, list(chosen)] = 1
        return k, n1, n2, k2, picks


def signatures(features: np.ndarray, bands: Bands) -> np.ndarray:
    """The 64-bit PartEnum signatures of a set, for its own band and the next one."""
    if not len(features):
        return np.empty(0, np.uint64)
    own, found = bands.band(len(features)), []
    for band in (own, own + 1):
        k, n1, n2, k2, picks = bands.plan(band)
        must = n1 - k // (k2 + 1)  # parts that a similar pair surely agrees on
        least = min(LEAST_COVER, len(features))
        for cut in range(ROUNDS + 1):
            spread = mix(features ^ np.uint64(_ODD[cut % 8]))
            cell = ((spread >> np.uint64(32)) * np.uint64(n1 * n2) >> np.uint64(32)).astype(np.int64)
            sums = np.zeros(n1 * n2, np.uint64)
            np.add.at(sums, cell, mix(spread + np.uint64(_ODD[7])))
            held = np.bincount(cell, minlength=n1 * n2).reshape(n1, n2).astype(np.uint64)
            chosen = sums.reshape(n1, n2) @ picks.T
            counts = held @ picks.T
            name = (np.uint64(band * 64 + cut) << np.uint64(32)) + np.arange(n1 * len(picks), dtype=np.uint64)
            signed = mix(chosen.ravel() + mix(name))
            poorest = counts.min(axis=1)
            # with fewer poor parts than agreeing ones, a similar set meets this one here: it keeps what this one keeps,
            # or its own parts that cover enough are kept by this one
            cover = next((c for c in range(least, 0, -1) if int((poorest < c).sum()) < must), 0)
            if cut == ROUNDS and not cover:
                found.append(signed)  # whatever they cover: exact for every set
                break
            found.append(signed[counts.ravel() >= max(cover, 1)])
            if cover:
                break
    return np.unique(np.concatenate(found))


def _combined(ids: np.ndarray, texts: list, n: int, num: int, den: int) -> tuple[list[np.ndarray], ...]:
    """Rows (kind, key, doc) of one batch, combined: equal sets once, each signature once.

    Kinds: 0 size of a set, 1 signature, 2 a pair of equal sets. Of the documents of one batch that share a
    signature, the first one alone goes on with it, as kind 5; all of them come as members of its bucket (3), and each
    other one as a pair with the first (4).
    """
    bands, sets = Bands(num, den), {}
    out = {kind: [] for kind in range(6)}
    keys, docs = [], []
    for doc, text in zip(ids, texts):
        features = shingles(text, n)
        out[0].append((len(features), doc))
        if doc is None or not len(features):
            continue
        whole = features.tobytes()
        first = sets.setdefault(xxhash.xxh3_128_digest(whole), (doc, whole))
        if first[0] != doc and first[1] == whole:
            out[2].append((first[0], doc))
            continue
        signed = signatures(features, bands)
        keys.append(signed)
        docs.append(np.full(len(signed), doc, np.int64))
    if keys:
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        first = np.r_[True, key[1:] != key[:-1]]
        leader = doc[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
        shared = ~first | np.r_[~first[1:], False]
        for kind, some in ((1, first & ~shared), (5, first & shared)):
            out[kind].append(np.stack([key[some].view(np.int64), doc[some]]))
        out[3].append(np.stack([key[shared].view(np.int64), doc[shared]]))
        out[4].append(np.unique(np.stack([leader[~first], doc[~first]]), axis=1))
    return out


def _sign(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _combined(batch.column(0).to_pylist(), batch.column(1).to_pylist(), n, num, den)
            kinds = (1, 3, 4, 5)
            parts = [part for k in kinds for part in out[k]]
            signed = np.concatenate(parts, axis=1) if parts else np.empty((2, 0), np.int64)
            side = out[0] + out[2]
            kind = np.r_[np.zeros(len(out[0]), np.int8), np.full(len(out[2]), 2, np.int8),
                         np.repeat(np.array(kinds, np.int8), [sum(part.shape[1] for part in out[k]) for k in kinds])]
            key = pa.concat_arrays([pa.array([s[0] for s in side], pa.int64()), pa.array(signed[0])])
            doc = pa.concat_arrays([pa.array([s[1] for s in side], pa.int64()), pa.array(signed[1])])
            yield pa.RecordBatch.from_arrays([pa.array(kind), key, doc], ["kind", "key", "doc"])

    return run


def _facts(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """One pass over the texts to (kind, key, a, b).

    Sizes (0), pairs of equal sets (2), candidate pairs across batches with their signature (1), candidate pairs whose
    bucket is known otherwise (4), members of a bucket inside a batch (3, in b). A bucket of two documents is its pair,
    and signatures that one document alone has end here.
    """
    rows = docs.select("doc_id", "text").mapInArrow(_sign(n, num, den), "kind byte, key long, doc long")
    led = F.col("kind").isin(1, 5)
    # rows that lead no bucket are apart by their document; one window for all, as each one of its own would shuffle again
    apart = rows.withColumn("apart", F.when(~led, F.coalesce("doc", F.lit(0))))
    bucket = Window.partitionBy("key", "apart").orderBy("doc").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = apart.select("kind", "key", "doc", F.first("doc").over(bucket).alias("first"),
                          F.count(F.lit(1)).over(bucket).alias("n"), F.max("kind").over(bucket).alias("most"))
    pair = led & (F.col("n") == 2) & (F.col("most") == 1)
    facts = marked.where(~led | (F.col("first") != F.col("doc"))).select(
        F.when(pair, F.lit(4)).when(led, F.lit(1)).otherwise(F.col("kind")).cast("byte").alias("kind"),
        F.when((led & ~pair) | (F.col("kind") == 3), F.col("key")).alias("key"),
        F.when(led, F.col("first")).when(F.col("kind") != 3, F.col("key")).alias("a"), F.col("doc").alias("b"))
    return staged(facts, "facts")


def sketch(features: np.ndarray) -> np.ndarray:
    """Parity sketch of a set: two bits or more an element, as 64-bit words; their number is a power of two."""
    words = 1 << max(0, (len(features) // 32).bit_length())
    h = mix(features + np.uint64(_ODD[6]))
    out = np.zeros(words, np.uint64)
    np.bitwise_xor.at(out, (h & np.uint64(words - 1)).astype(np.int64), np.uint64(1) << (h >> np.uint64(58)))
    return out


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows) as they would be with fewer words."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _set_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, n) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s).tobytes() for s in sets], pa.binary()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], ["doc", "size", "sketch", "digest", "features"])

    return run


def similar(left: np.ndarray, right: np.ndarray, num: int, den: int) -> bool:
    """The threshold on two sorted sets, in whole numbers; empty sets are similar to nothing."""
    if min(len(left), len(right)) * den < max(len(left), len(right)) * num or not len(left):
        return False
    both = len(np.intersect1d(left, right, assume_unique=True))
    return den * both >= num * (len(left) + len(right) - both)


def may_link(differ: np.ndarray | int, left: np.ndarray | int, right: np.ndarray | int, num: int, den: int):
    """Whether sets of these sizes whose sketches differ in so many bits can reach the threshold."""
    fits = np.minimum(left, right) * den >= np.maximum(left, right) * num
    return fits & (np.minimum(left, right) > 0) & (differ * (den + num) <= (den - num) * (left + right))


def _near_texts(docs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, bool]:
    """(doc, text) of the documents in a table of distinct ``doc`` and of a few others, and whether they may be many.

    A filter of one bit a hash, ``FILTER_BITS`` bits a node at a time up to a fixed size, drops most of the others where
    they lie; a fuller one lets more of them through, and never loses one of the nodes.
    """
    least = -(-nodes.count() * FILTER_BITS // BLOCK_BITS) or 1
    blocks = min(least, MOST_BLOCKS)
    hashed = F.xxhash64("doc")
    block, bit = F.pmod(hashed, F.lit(blocks)).alias("block"), F.pmod(F.shiftright(hashed, 32), F.lit(BLOCK_BITS))
    bits = nodes.select(block, bit.alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    placed = docs.select(F.col("doc_id").alias("doc"), "text").where("doc is not null").withColumn("block", block).withColumn("bit", bit)
    near = placed.join(F.broadcast(bits), "block").where(
        F.expr("shiftright(cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int), cast(bit % 8 as int)) % 2 = 1"))
    return near.select("doc", "text"), least > MOST_BLOCKS


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc, text) of the documents in a table of distinct ``doc``; the join shuffles the texts that pass the filter."""
    # no semi join: Spark would push it below the filter's join
    return _near_texts(docs, nodes)[0].join(nodes, "doc")


def _sets_of(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """Sets of the documents in a table of distinct ``doc``; a few others come along, as their texts are not shuffled.

    Every reader joins the sets by the documents it asks for. Where the filter is full, a join drops the others.
    """
    near, many = _near_texts(docs, nodes)
    return staged((near.join(nodes, "doc") if many else near).mapInArrow(
        _set_rows(n), "doc long, size long, sketch binary, digest binary, features binary"), "sets")


def _ends(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a, b) with columns of the sets of both ends."""
    for x in "ba":
        end = sets.select(F.col("doc").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
        pairs = pairs.join(end, x)
    return pairs.select("a", "b", *[f"{c}_{x}" for x in "ab" for c in columns])


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are similar: by their sketches first, what passes by the sets.

    Equal sets are known by their size and 128-bit digest and are not fetched.
    """

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, same = [], []
            for m, x, d, n, y, e in zip(*[batch.column(i).to_pylist() for i in range(2, 8)]):
                p, q = (np.frombuffer(s, np.uint64)[None] for s in (x, y))
                words = min(p.shape[1], q.shape[1])
                differ = int(np.bitwise_count(folded(p, words) ^ folded(q, words)).sum())
                ok.append(bool(may_link(differ, m, n, num, den)))
                same.append(m == n and d == e)
            found = batch.select(["a", "b"]).append_column("same", pa.array(same, pa.bool_()))
            yield found.filter(pa.array(ok, pa.bool_()))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den) for x, y in zip(left, right)]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    # the few pairs left go to the sets, as Spark may broadcast a written table of their size; the sets stay in place
    hopeful = staged(_ends(pairs, sets, ["size", "sketch", "digest"]).mapInArrow(sift, "a long, b long, same boolean"), "hopeful")
    unsettled = hopeful.where("not same").select("a", "b")
    left = unsettled.join(sets.select(F.col("doc").alias("a"), F.col("features").alias("fa")), "a")
    right = unsettled.join(sets.select(F.col("doc").alias("b"), F.col("features").alias("fb")), "b")
    by_sets = left.join(right, ["a", "b"]).select("a", "b", "fa", "fb").mapInArrow(exact, "a long, b long")
    return hopeful.where("same").select("a", "b").union(by_sets)


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Add the components la, lb of both ends; a node outside the table is its own component."""
    for x in "ab":
        named = labels.select(F.col("node").alias(x), F.col("component").alias(f"l{x}"))
        pairs = pairs.join(named, x, "left").withColumn(f"l{x}", F.coalesce(f"l{x}", x))
    return pairs


def _cell_pairs(num: int, den: int, every: bool):
    """Pairs of one bin whose sketches allow a link: the nearest of each outlier and component of a cell, or every one."""

    def run(table: pa.Table) -> pa.Table:
        doc, label, size = (table[c].to_numpy() for c in ("doc", "label", "size"))
        outer = table["outer"].to_numpy(zero_copy_only=False)
        width = np.array([len(x) // 8 for x in table["sketch"].to_pylist()])
        raw = table["sketch"].to_pylist()
        cell = np.stack([table[c].to_numpy() for c in ("key", "block", "outer_block")])
        order = np.lexsort((width, *cell))
        cuts = np.flatnonzero((cell[:, order[1:]] != cell[:, order[:-1]]).any(axis=0)) + 1
        found = set()
        nearest: dict[tuple[int, int], tuple[int, int]] = {}
        for rows in np.split(order, cuts):
            outliers, members = rows[outer[rows]], rows[~outer[rows]]
            for w in np.unique(width[outliers]):
                mine = outliers[width[outliers] == w]
                left = np.frombuffer(b"".join(raw[i] for i in mine), np.uint64).reshape(len(mine), w)
                for v in np.unique(width[members]):
                    if max(v, w) > 2 * min(v, w):
                        continue  # sizes a factor of two apart are below any threshold over one half
                    theirs = members[width[members] == v]
                    right = np.frombuffer(b"".join(raw[i] for i in theirs), np.uint64).reshape(len(theirs), v)
                    near, far = folded(left, min(v, w)), folded(right, min(v, w))
                    for i, row in zip(mine, near):
                        differ = np.bitwise_count(far ^ row).sum(axis=1, dtype=np.int64)
                        ok = may_link(differ, size[theirs], size[i], num, den) & (label[theirs] != label[i])
                        if every:
                            found.update((min(doc[i], doc[j]), max(doc[i], doc[j])) for j in theirs[ok])
                            continue
                        for j, d in zip(theirs[ok], differ[ok]):
                            key = (doc[i], label[j])
                            nearest[key] = min(nearest.get(key, (d, doc[j])), (d, doc[j]))
        found.update((min(x, y), max(x, y)) for (x, _), (_, y) in nearest.items())
        a, b = zip(*sorted(found)) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _bucket_cells(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, block, outer_block, doc, outer) of the buckets of three or more that hold several components.

    In a bucket of two the pair was a candidate already. Of buckets of the same members one is searched: 128 bits of
    their hashes tell them.
    """
    shared = facts.where("kind in (1, 3)").select("key", F.explode(F.array_compact(F.array("a", "b"))).alias("doc")).distinct()
    named = shared.join(labels.select(F.col("node").alias("doc"), F.col("component").alias("label")), "doc", "left")
    signed = named.select("key", "doc", F.coalesce("label", "doc").alias("label"))
    parts = signed.groupBy("key", "label").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y"))
    weights = parts.groupBy("key").agg(
        F.max_by("label", F.struct("n", "label")).alias("hub"), F.sum("n").alias("n"), F.max("n").alias("most"),
        F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    alike = weights.where("n > 2 and most < n").groupBy("x", "y", "n").agg(F.min(F.struct("key", "hub", "most")).alias("one"))
    plan = alike.select(
        "one.key", "one.hub", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"),
        F.ceil((F.col("n") - F.col("one.most")) / BLOCK_ROWS).cast("int").alias("outer_blocks"))
    members = signed.join(plan, "key")
    mine, salt = F.xxhash64("doc"), F.xxhash64("doc", F.lit(1))
    inner = members.select(
        "key", "doc", F.pmod(mine, "blocks").cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("outer_blocks") - 1)).alias("outer_block"), F.lit(False).alias("outer"))
    outer = members.where("label <> hub").select(
        "key", "doc", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(salt, "outer_blocks").cast("int").alias("outer_block"), F.lit(True).alias("outer"))
    return staged(inner.unionByName(outer), "cells")


def _bucket_pairs(cells: DataFrame, sets: DataFrame, labels: DataFrame, num: int, den: int, every: bool) -> DataFrame:
    """Pairs (a, b) of different components that share a cell and may link by their sketches."""
    bins = max(1, cells.count() // BIN_ROWS)
    known = sets.select("doc", "size", "sketch").join(
        labels.select(F.col("node").alias("doc"), F.col("component").alias("label")), "doc", "left")
    dealt = cells.join(known.withColumn("label", F.coalesce("label", "doc")), "doc").withColumn(
        "bin", F.pmod(F.xxhash64("key", "block", "outer_block"), F.lit(bins)))
    return dealt.groupBy("bin").applyInArrow(_cell_pairs(num, den, every), "a long, b long").distinct()


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document, links at Jaccard >= num / den.

    ``component_id`` is the smallest doc_id reachable by links. A null or empty text, or one of
    white space, has no n-grams and links with nothing. Rows that repeat a doc_id are one document:
    it has the links of all its rows, and n_shingles is their largest set. Rows without a doc_id link
    with nothing and come back as one row with nulls for both ids. An empty table gives an empty table.
    """
    if 2 * num <= den or num > den:
        raise ValueError("the threshold must lie above one half and not above one")
    facts = _facts(docs, n, num, den)
    pairs, sure = facts.where("kind in (1, 4)").select("a", "b"), facts.where("kind = 2").select("a", "b")
    nodes = staged(pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct(), "nodes")
    sets = _sets_of(docs, nodes, n)
    nearest = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    linked = staged(sure.union(_verified(nearest, sets, num, den)), "linked")
    labels = connected_components(linked)
    rest = _labelled(pairs.distinct().join(nearest, ["a", "b"], "left_anti"), labels).where("la <> lb").select("a", "b")
    linked = staged(linked.union(_verified(rest, sets, num, den)), "linked")
    labels = connected_components(linked)
    # the nearest pairs first, which join most of what belongs together; then every pair that is left
    cells = _bucket_cells(facts, labels)
    for every in (False, True):
        more = staged(_verified(_bucket_pairs(cells, sets, labels, num, den, every), sets, num, den), "linked")
        if not more.isEmpty():
            linked = linked.union(more)
            labels = connected_components(linked)
    sizes = facts.where("kind = 0").groupBy(F.col("b").alias("doc_id")).agg(F.max("a").alias("n_shingles"))
    return sizes.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Four-word sets of all documents, linked at 0.85."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85, 100)
