"""SimHash near-duplicates through an index of bytes by position, with count filtering.

Two fingerprints of 64 bits that differ in at most three bits differ in at most three of their eight
bytes: they share five bytes at their positions at least. Of any five positions, three lie in one half of
the fingerprint, so each fingerprint is posted under the bytes of the eight triples of positions inside a half,
and every pair of the kind meets in some list. There its shared bytes are tallied over all positions, the pair is
dropped below five, and the others are verified on the differing bits. Equal fingerprints are one entry.

A list that holds many fingerprints is not compared: its members are posted again under one more position, by
four further positions of which one must be shared, first bytes, then half bytes. Lists end at 52 shared bits,
which leave 4,096 fingerprints at most. Lists with more than a fixed share of all postings, of which there is a
bounded number, are posted again where they lie, without a shuffle. A list hands on a tree of its links, never its pairs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import join_by_hot_key, staged
from gleaner.llm.components import connected_components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Bytes that two linked fingerprints share at least.
SHARED_BYTES = 8 - DISTANCE
#: Fingerprints of a list that are compared; longer lists are posted under one more position.
LIST_SIZE = 1024
#: Lists with more than this part of all postings do not pass a shuffle: so many at most.
HOT_LISTS = 10_000
#: Shingles that one step hashes.
CHUNK = 1 << 16
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None) -> int:
    """The fingerprint of a text: bits that over half of its shingles' hashes hold; without words 0."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(SHINGLE, len(words)) - 1
    starts, ends = starts[: len(words) - last], ends[last:]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        spans = zip(starts[at: at + CHUNK].tolist(), ends[at: at + CHUNK].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) a row: the fingerprint of the text as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def first_masks() -> list[int]:
    """The bytes of each triple of positions inside a half, as masks."""
    return [_signed(sum(0xFF << 8 * i for i in c)) for half in (range(4), range(4, 8)) for c in combinations(half, 3)]


def next_masks(mask: int) -> list[int]:
    """The mask with one more position, four times: three positions differ at most, so one of any four is shared."""
    for width, full in ((8, 0xFF), (4, 0xF)):
        free = [full << i for i in range(0, 64, width) if not mask >> i & full]
        if len(free) > DISTANCE:
            return [_signed((mask & (1 << 64) - 1) | more) for more in free[: DISTANCE + 1]]
    return []


def mask_tree() -> dict[int, list[int]]:
    """Every mask that a list may stand under, with those that follow it."""
    tree, todo = {}, first_masks()
    while todo:
        mask = todo.pop()
        if mask not in tree:
            tree[mask] = next_masks(mask)
            todo += tree[mask]
    return tree


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs whose tally of shared bytes reaches the minimum and whose bits differ in ``DISTANCE`` places at most."""
    differ = a ^ b
    tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    out = tally >= SHARED_BYTES
    out[out] = np.bitwise_count(differ[out]) <= DISTANCE
    return out


def list_links(fps: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (fingerprint, other one) that connect the same members as all links within consecutive lists."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    root, at, shift = np.arange(len(fps)), np.arange(len(fps)), 1
    while len(at := at[at + shift < ends[at]]):
        met = at[linked(fps[at], fps[at + shift])]
        a, b = root[met], root[met + shift]
        while len(a := a[differ := a != b]):
            b = b[differ]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while len(np.flatnonzero(root != (up := root[root]))):
                root = up
            a, b = root[a], root[b]
        shift += 1
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[moved], fps[root[moved]]


def _rows(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (mask, a, b)], ["mask", "a", "b"])


def _post_again(mask: int, fps: np.ndarray, tree: dict[int, list[int]]) -> pa.RecordBatch:
    """The members of one list under its next masks."""
    more = tree[mask]
    members = np.tile(fps.view(np.int64), len(more))
    return _rows(np.repeat(np.array(more, np.int64), len(fps)), members, members)


def _tally(batches: Iterator[pa.RecordBatch], tree: dict[int, list[int]], list_size: int) -> Iterator[pa.RecordBatch]:
    """Links (mask 0, a, b) of lists sorted by (mask, bytes, fp); members of long lists as (next mask, a, a)."""
    masks, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = np.array([mask for mask, more in tree.items() if not more], np.int64)
    going_on = None  # the long list whose members are posted again as they come

    def step(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal masks, fps, going_on
        again = np.concatenate([[False], (masks[1:] == masks[:-1]) & (fps[1:] == fps[:-1])])
        masks, fps = masks[~again], fps[~again]  # two paths may lead to one list
        shared = fps & masks.view(np.uint64)
        cuts = np.flatnonzero(np.concatenate([[True], (masks[1:] != masks[:-1]) | (shared[1:] != shared[:-1])]))
        sizes = np.diff(np.concatenate([cuts, [len(fps)]]))
        long = (sizes > list_size) & ~np.isin(masks[cuts], ends)
        long[0] |= (int(masks[0]), int(shared[0])) == going_on
        for i in np.flatnonzero(long):
            yield _post_again(int(masks[cuts[i]]), fps[cuts[i]: cuts[i] + sizes[i]], tree)
        # the last list may go on in the next batch
        going_on = (int(masks[-1]), int(shared[-1])) if long[-1] else None
        done = len(sizes) - (0 if last or long[-1] else 1)
        short = ~long[:done] & (sizes[:done] > 1)
        a, b = list_links(fps[: sizes[:done].sum()][np.repeat(short, sizes[:done])], sizes[:done][short])
        if len(a):
            yield _rows(np.zeros(len(a)), a.view(np.int64), b.view(np.int64))
        kept = int(sizes[:done].sum())
        masks, fps = masks[kept:], fps[kept:]

    for batch in batches:
        masks = np.concatenate([masks, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
        if len(fps):
            yield from step(last=False)
    if len(fps):
        yield from step(last=True)


def fingerprint_links(fps: DataFrame, list_size: int = LIST_SIZE) -> DataFrame:
    """Edges (a, b) that connect the different fingerprints (column ``fp``) as links of ``DISTANCE`` bits do."""
    tree = mask_tree()

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _tally(batches, tree, list_size)

    def post_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, members = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for mask in np.unique(masks).tolist():
                yield _post_again(mask, members[masks == mask], tree)

    todo = fps.select(F.explode(F.array(*map(F.lit, first_masks()))).alias("mask"), "fp")
    schema, edges = "mask long, a long, b long", []
    while True:
        lists = todo.withColumn("shared", F.col("fp").bitwiseAND(F.col("mask")))
        size = max(list_size, todo.count() // HOT_LISTS)  # no more than HOT_LISTS lists are longer
        hot = lists.where(~F.col("mask").isin([m for m, more in tree.items() if not more])).groupBy("mask", "shared").agg(
            F.count(F.lit(1)).alias("n")).where(F.col("n") > size).select("mask", "shared")
        at = ["mask", "shared"]
        cold = lists.join(F.broadcast(hot), at, "left_anti").repartition(*at).sortWithinPartitions(*at, "fp")
        found = staged(cold.select("mask", "fp").mapInArrow(tally, schema).union(
            lists.join(F.broadcast(hot), at, "left_semi").select("mask", "fp").mapInArrow(post_again, schema)), "tallies")
        edges.append(found.where("mask = 0").select("a", "b"))
        todo = found.where("mask <> 0").select("mask", F.col("a").alias("fp"))
        if todo.isEmpty():
            return reduce(DataFrame.union, edges)


def simhash_components(docs: DataFrame, list_size: int = LIST_SIZE) -> DataFrame:
    """(doc_id, fingerprint, n_same, component_id), a row per row of docs.

    ``fingerprint`` is 16 lowercase hexadecimal digits, ``n_same`` the rows that have it, ``component_id``
    the smallest doc_id that links reach. A null text counts as empty; texts without words have the
    fingerprint zero and are linked like others. Rows that repeat a doc_id are judged one by one, each by its
    own text. A null doc_id takes part, but is no smallest doc_id: a component without any other has a null
    component_id. An empty table gives an empty table.
    """
    rows = staged(fingerprints(docs), "fingerprints")
    fps = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "entries")
    parts = connected_components(fingerprint_links(fps, list_size)).withColumnRenamed("node", "fp")
    members = parts.join(fps, "fp")
    least = members.groupBy("component").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = join_by_hot_key(members.select("component", "fp"), least, "component").select("fp", "component_id")
    groups = fps.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), "n")
    return join_by_hot_key(rows, staged(groups, "groups"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("n").alias("n_same"), "component_id")


def op12_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_components(docs).select("doc_id", "fingerprint", "component_id")
