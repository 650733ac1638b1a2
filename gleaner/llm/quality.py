"""Quality rules: base counts of every text, and a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed n-grams (word 1- and 2-grams, byte 3-grams) are counted: the raw
corpus (all documents) and the trusted target (labelled good documents, half of a bounded sample). A
document's score is the sum of log(target / raw) over its n-grams, divided by their number. Every
document is held against one fixed threshold, fitted once on the other half of the sample, whose
scores the target has not seen; nothing is drawn at random.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Hash buckets of n-grams, a power of two: the size of both models.
BUCKETS = 1 << 15
#: Labelled rows that the target and the threshold are fitted on, at most.
LABELLED_ROWS = 20_000
#: What losing good documents counts for against catching poor ones, in shares of each.
GOOD_WEIGHT = 5
#: Rows of an Arrow batch that are Python objects at a time.
SLICE_ROWS = 64
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in slices, so that a worker's memory does not follow the size of its batches."""
    return (batch.slice(i, SLICE_ROWS) for batch in batches for i in range(0, batch.num_rows, SLICE_ROWS))


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, compared exactly."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, window, seen = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = seen[window] > 1
    held = np.zeros(len(words), bool)
    for i in range(3):
        held[i: i + len(again)] |= again
    return int(held.sum())


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int, bool]:
    """The counts of FEATURES for a text and its words between ASCII white space."""
    lines = [line for line in text.split("\n") if line.encode().split()]
    white = sum(map(text.count, " \t\n\x0b\x0c\r"))
    repeated = repeat_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > 50 * len(words)
    return len(words), len(text) - white, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, failed


def ngram_buckets(text: bytes, words: list[bytes]) -> np.ndarray:
    """Buckets of the word 1- and 2-grams and the byte 3-grams of a text, with repeats."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    c = np.frombuffer(text, np.uint8).astype(np.uint64)
    bytes3 = (c[:-2] << np.uint64(16) | c[1:-1] << np.uint64(8) | c[2:]) * np.uint64(0x165667B19E3779F9)
    return (np.concatenate([h, pairs, bytes3]) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


@dataclass
class Model:
    """Log ratio of each bucket and the least score of a document that stays."""

    ratio: np.ndarray
    threshold: float

    def score(self, text: bytes, words: list[bytes]) -> float:
        found = ngram_buckets(text, words)
        return float(self.ratio[found].mean()) if len(found) else 0.0


def ngram_totals(docs: DataFrame, trusted: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket over all documents, and over those with trusted ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (text or "").encode()
                found = np.bincount(ngram_buckets(raw, raw.split()), minlength=BUCKETS)
                total[0] += found
                if doc in trusted:
                    total[1] += found
        held = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[0][held]), pa.array(total[1][held])],
                                         ["bucket", "raw", "target"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "bucket int, raw long, target long")
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r.bucket], target[r.bucket] = r.raw, r.target  # as many rows as buckets at most
    return raw, target


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log(target / raw) per bucket, the target smoothed towards the raw shares so that unseen buckets stay finite."""
    p_raw = (raw + 1) / (raw.sum() + len(raw))
    weight = 0.05 * max(target.sum(), 1)
    return np.log((target + weight * p_raw) / (target.sum() + weight)) - np.log(p_raw)


def best_threshold(scores: np.ndarray, good: np.ndarray) -> float:
    """The cut that catches most poor documents, less ``GOOD_WEIGHT`` times the good ones lost.

    It lies half-way between neighbouring scores, the lowest one if several tie.
    """
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(scores, kind="stable")
    scores, good = scores[order], good[order]
    lost = np.r_[0, np.cumsum(good)] / good.sum()
    caught = np.r_[0, np.cumsum(~good)] / (~good).sum()
    cut = int(np.argmax(caught - GOOD_WEIGHT * lost))
    return -np.inf if cut == 0 else float((scores[cut - 1] + scores[min(cut, len(scores) - 1)]) / 2)


def fit(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> Model:
    """Counts over all documents; target and threshold from at most ``labelled_rows`` labelled ones.

    The sample takes the labels with the least hash of doc_id. Without labels of both kinds nothing
    but the base rules rejects.
    """
    sample = {r.doc_id: r.quality for r in labels.where("doc_id is not null and quality is not null").select("doc_id", "quality")
              .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(labelled_rows).collect()}
    fitted = {d for d in sample if zlib.crc32(str(d).encode()) % 2 == 0}
    ratio = log_ratio(*ngram_totals(docs, {d for d in fitted if sample[d] == 1}))
    model, others = Model(ratio, -np.inf), sample.keys() - fitted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held = [(d, model.score(raw, words)) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    if d in others and t and not base_counts(t, words := (raw := t.encode()).split())[-1]]
            yield pa.RecordBatch.from_pylist([{"doc_id": d, "score": s} for d, s in held],
                                             pa.schema([("doc_id", pa.int64()), ("score", pa.float64())]))

    # a row for each labelled row of the sample
    seen = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double").groupBy("doc_id").agg(F.min("score").alias("s")).collect()
    if seen:
        seen.sort()
        model.threshold = best_threshold(np.array([r.s for r in seen]), np.array([sample[r.doc_id] == 1 for r in seen]))
    return model


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of docs (but columns named like the new ones) with FEATURES, score and kept.

    Words stand between ASCII white space; a null or empty text has none, fails the base rules and
    goes. Rows are judged one by one, so repeated rows get the same verdict. An empty table gives
    an empty table.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    own = [c for c in docs.columns if c not in (*names, "score", "kept")]
    at = own.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column(at).to_pylist():
                words = (raw := (text or "").encode()).split()
                base = base_counts(text or "", words)
                score = model.score(raw, words)
                rows.append((*base, score, not base[-1] and score >= model.threshold))
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(c, k) for c, k in zip(columns, kinds)]], [*own, *names, "score", "kept"])

    kept = docs.select(*own)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{schema}, {FEATURES}, score double, kept boolean")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict for all documents, target from the labels table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, model).drop("text")
