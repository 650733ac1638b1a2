"""Token ids in binary files: frequency-ranked ids, byte-aligned, with separate control bytes.

A file set is a folder of two Parquet tables. ``ranks`` (rank, id, count) numbers the ids from the most
frequent. ``blocks`` holds runs of documents in ascending doc_id order, one row a block:

* ``part``, ``seq``: place of the block; parts and, within them, blocks follow the ids.
* ``n_ids``; ``doc_ids`` (array of long); ``counts`` (array of int): ids of each document.
* ``control``: two bits an id, four ids a byte from the low bits: bytes of its rank less one.
* ``data``: the ranks, each in that many bytes, low byte first.

Spark's writer commits the tables, so lost executors leave no half-written file, and any store that
Spark can reach will do. A document may be longer than a block; it is never cut.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.tokens import default_path, word_ids
from gleaner.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOCS_PER_BLOCK = 256
BLOCK_SCHEMA = "part int, seq long, n_ids long, doc_ids array<long>, counts array<int>, control binary, data binary"
#: Bytes of each of the four ids of a control byte.
LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.int64)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    quads = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    quads[: len(code)] = code
    control = (quads.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    kept = np.arange(4) <= code[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values behind control and data bytes."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    starts = np.cumsum(lengths) - lengths
    padded = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    word = padded[starts] | padded[starts + 1] << 8 | padded[starts + 2] << 16 | padded[starts + 3] << 24
    return word & MASKS[lengths]


def ordered_ids(docs: DataFrame, path: str, end_id: int, docs_per_block: int) -> DataFrame:
    """Blocks (part, seq, doc_ids, counts, ids as little-endian 32-bit) of all documents by ascending doc_id, staged.

    The texts are dealt by ranges of doc_id and encoded once; the two passes that follow read numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        with word_ids(path) as encoder:
            for batch in batches:
                for at in range(0, batch.num_rows, docs_per_block):
                    some = batch.slice(at, docs_per_block)
                    ids, limits = encoder.encode(some.column(1).to_pylist(), end_id)
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int64()),
                        "doc_ids": pa.array([some.column(0).to_pylist()], pa.list_(pa.int64())),
                        "counts": pa.array([np.diff(limits).astype(np.int32)], pa.list_(pa.int32())),
                        "ids": pa.array([ids.astype("<u4").tobytes()], pa.binary())})
                    seq += 1

    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = dealt.mapInArrow(run, "part int, seq long, doc_ids array<long>, counts array<int>, ids binary")
    folder = scratch_path(docs.sparkSession, "ordered-ids")
    rows.write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(rows.schema).parquet(folder)


def token_counts(blocks: DataFrame) -> DataFrame:
    """(id, count) of every id of all blocks: one row an id and task, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                seen = np.bincount(np.frombuffer(raw.as_py(), "<u4"), minlength=len(total))
                seen[: len(total)] += total
                total = seen
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["id", "count"])

    return blocks.select("ids").mapInArrow(run, "id int, count long").groupBy("id").agg(F.sum("count").alias("count"))


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 1,
                      docs_per_block: int = DOCS_PER_BLOCK) -> None:
    """Encode every text and write a file set to a new folder.

    A null or empty text gives the end id alone. Documents stand in ascending doc_id order (nulls
    first), rows that repeat a doc_id in the order of their texts. No rows give an empty file set.
    """
    blocks = ordered_ids(docs, path or default_path(), end_id, docs_per_block)
    # the vocabulary bounds this table and the array that travels with the tasks
    ranked = token_counts(blocks).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "id")) - 1)
    ranked.select("rank", "id", "count").write.parquet(f"{folder}/ranks")
    rank_of = _ids_by_rank(docs.sparkSession, folder)
    inverse = np.zeros(int(rank_of.max(initial=0)) + 1, np.uint32)
    inverse[rank_of] = np.arange(len(rank_of), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [pack(inverse[np.frombuffer(raw.as_py(), "<u4")]) for raw in batch.column("ids")]
            sizes = [len(raw.as_py()) // 4 for raw in batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("seq"), pa.array(sizes, pa.int64()), batch.column("doc_ids"), batch.column("counts"),
                 pa.array([c for c, _ in coded], pa.binary()), pa.array([d for _, d in coded], pa.binary())],
                ["part", "seq", "n_ids", "doc_ids", "counts", "control", "data"])

    blocks.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(f"{folder}/blocks")


def _ids_by_rank(spark: SparkSession, folder: str) -> np.ndarray:
    """The ids in order of rank: as many as the vocabulary has at most."""
    rows = spark.read.schema("rank int, id int").parquet(f"{folder}/ranks").collect()
    return np.array([r.id for r in sorted(rows)], np.int64)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, optionally ids as little-endian 32-bit binary) of every document of a file set."""
    id_of = _ids_by_rank(spark, folder).astype("<u4")
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks")
    extra, names = (", ids binary", ["ids"]) if with_ids else ("", [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = id_of[unpack(row["control"], row["data"], row["n_ids"])]
                counts = np.array(row["counts"], np.int64)
                limits = np.r_[0, np.cumsum(counts)]
                raw = [ids[a:b].tobytes() for a, b in zip(limits, limits[1:])]
                n = len(raw)
                columns = [pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int64()),
                           pa.array(row["doc_ids"], pa.int64()), pa.array(limits[:-1]), pa.array(counts),
                           pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    columns + [pa.array(raw, pa.binary())] * with_ids, ["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32", *names])

    read = blocks.mapInArrow(run, f"part int, seq long, doc_id long, inner long, n_tokens long, ids_crc32 long{extra}")
    sizes = blocks.select("part", "seq", "n_ids")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("within", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part").select(
        "part", "seq", (F.col("before") + F.col("within")).alias("base"))
    return read.join(bases, ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *names)


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    folder = scratch_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_token_files(spark, folder)
