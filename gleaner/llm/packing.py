"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Best-fit decreasing only sees lengths, and lengths are bounded by the capacity. So the algorithm runs
over the histogram of lengths: bins that hold equal amounts are a run of bin numbers, and a
segment tree over remaining capacities finds the tightest open run in logarithmic time. The result is
what placing every document one by one would give, as a table of a few thousand runs; documents
find their bin from their number among the documents of their length.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import file_order, ordinal_in_file_order, ordinal_within, staged
from gleaner.llm.tokens import WordIds, default_path, word_ids

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 2048
#: Rows of an Arrow batch that are encoded at a time.
SLICE_ROWS = 1024


class OpenBins:
    """Runs (first bin, bins) by remaining capacity, with a segment tree over the capacities."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.leaves)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def _mark(self, left: int, value: bool) -> None:
        node = self.leaves + left
        self.some[node] = value
        while node > 1:
            node //= 2
            self.some[node] = self.some[2 * node] or self.some[2 * node + 1]

    def push(self, left: int, run: tuple[int, int]) -> None:
        if left and run[1]:
            self.runs.setdefault(left, []).append(run)
            self._mark(left, True)

    def pop(self, need: int) -> tuple[int, tuple[int, int]] | None:
        """The run with the least remaining capacity of at least ``need``."""
        node = self.leaves + need
        if not self.some[node]:
            while node > 1 and (node % 2 or not self.some[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.some[2 * node] else 2 * node + 1
        left = node - self.leaves
        run = self.runs[left].pop()
        if not self.runs[left]:
            self._mark(left, False)
        return left, run


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first number, first bin, per bin, offset) of best-fit decreasing over a histogram.

    The items of a length from ``first number`` on go to the bins from ``first bin`` on, ``per bin``
    each, the first of a bin at ``offset``.
    """
    bins, runs, used = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a length of {length} does not fit into {capacity}")
        left_over, number = counts[length], 0
        while left_over:
            found = bins.pop(length)
            if found is None:
                need = -(-left_over // (capacity // length))
                found, used = (capacity, (used, need)), used + need
            room, (first, n) = found
            each = room // length  # a bin stays the tightest until it has no room for one more
            full = min(n, left_over // each)
            runs.append((length, number, first, each, capacity - room))
            bins.push(room - each * length, (first, full))
            number, left_over = number + full * each, left_over - full * each
            if full < n:
                some = left_over
                if some:  # fewer than a bin takes: they follow the run's rule in its next bin
                    bins.push(room - some * length, (first + full, 1))
                    number, left_over = number + some, 0
                bins.push(room, (first + full + bool(some), n - full - bool(some)))
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows with ``length`` (1 to capacity), doc_id and piece, plus sequence_id and offset.

    A row is never cut. Equal lengths are told apart by a hash of doc_id, or by the column ``file_order`` where
    ``pieces`` has one (it is left out of the result); copies and ties may hold any share of the rows. An empty table gives an empty table. ``pieces`` is read three times: stage it.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = best_fit_decreasing(counts, capacity)
    plan = pieces.sparkSession.createDataFrame(runs, "length long, first long, bin long, each long, at long")
    by_length = plan.groupBy("length").agg(F.collect_list(F.struct("first", "bin", "each", "at")).alias("runs"))
    if "file_order" in pieces.columns:
        numbered = ordinal_in_file_order(pieces, "length", "file_order", ["piece"], "number")
    else:
        numbered = ordinal_within(pieces, "length", "doc_id", ["piece"], "number")
    # as many rows as there are lengths, each run once: bounded by the capacity
    placed = numbered.join(F.broadcast(by_length), "length").withColumn(
        "run", F.array_max(F.filter("runs", lambda r: r["first"] <= F.col("number"))))
    inner = F.col("number") - F.col("run.first")
    return placed.select(
        *[c for c in pieces.columns if c != "file_order"], (F.col("run.bin") + F.floor(inner / F.col("run.each"))).alias("sequence_id"),
        (F.col("run.at") + inner % F.col("run.each") * F.col("length")).alias("offset"))


def tokenized_pieces(docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = CAPACITY,
                     with_ids: bool = False, in_file_order: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, optionally ids as little-endian 32-bit binary and file_order).

    Each text's ids and the end id; only a document longer than the capacity is cut. A null or empty
    text is the end id alone.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with word_ids(path) as encoder:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_ROWS):
                    yield cut(batch.slice(at, SLICE_ROWS), encoder)

    def cut(batch: pa.RecordBatch, encoder: WordIds) -> pa.RecordBatch:
        ids, limits = encoder.encode(batch.column(1).to_pylist(), end_id)
        ids = ids.astype("<u4")
        sizes = np.diff(limits)
        cuts = -(-sizes // capacity)
        doc = np.repeat(np.arange(len(sizes)), cuts)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        start = piece * capacity
        length = np.minimum(capacity, sizes[doc] - start)
        raw = [ids[a:a + n].tobytes() for a, n in zip(limits[doc] + start, length)]
        columns = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                   pa.array([zlib.crc32(x) for x in raw], pa.int64())]
        columns += [pa.array(raw, pa.binary())] * with_ids
        if in_file_order:
            columns.append(batch.column(2).take(pa.array(doc)))
        return pa.RecordBatch.from_arrays(
            columns, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids + ["file_order"] * in_file_order)

    extra = ", ids binary" if with_ids else ""
    order = [file_order().alias("file_order")] * in_file_order
    if in_file_order:
        extra += ", file_order struct<part:int,file:string,start:long,row:long>"
    return docs.select("doc_id", "text", *order).mapInArrow(
        run, f"doc_id long, piece int, start long, length long, ids_crc32 long{extra}")


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = CAPACITY,
                   with_ids: bool = False, in_file_order: bool = False) -> DataFrame:
    """Tokenise all documents and place every piece: the pieces with sequence_id and offset.

    With ``in_file_order`` equal lengths follow the order in which ``docs`` was written.
    """
    return pack(staged(tokenized_pieces(docs, path, end_id, capacity, with_ids, in_file_order), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) from placed pieces with ids: a sequence has at most the capacity."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), held.alias("held")).select(
        "sequence_id", "length",
        F.aggregate("held", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
