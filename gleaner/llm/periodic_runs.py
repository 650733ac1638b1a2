"""Periodic runs of words, found by block convolution.

A run is a stretch of words with smallest period q, at least ``max(6, 4 * q)`` long, that no neighbouring
word extends. Periods from B to 2 B - 1, B a power of two, are found at the scale B: the text is cut into
blocks of B words, and the sum of squared differences of a block against the window behind it is taken at
all distances from B to 2 B - 1 at once, by number-theoretic transforms modulo primes whose product exceeds
any such sum. A sum of zero is an occurrence of the block. A run of period q holds a whole block and its
occurrence q words on, so every run has a seed; seeds are extended word by word to both sides.

Two rules save work and lose nothing. A block takes part only if each of its words occurs again within
2 B words. Inside a run of a smaller period p a block of more than p words occurs at multiples of p only,
which give the same run: such blocks and seeds are left out. What is left has a smallest period above a
quarter of its length, so a block has few seeds and the work is n log(n)^2 for a text of n words.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Primes c * 2^k + 1 with the generator 3, for transforms of up to 2^23 words, which blocks of 2^22 words need.
PRIMES = (998244353, 469762049, 167772161)
GENERATOR = 3

#: Words that a text must stay below: longer ones would need longer transforms.
MOST_WORDS = 1 << 25
MIN_LENGTH = 6
MIN_REPEATS = 4
#: Numbers that one batch of transforms holds.
BATCH = 1 << 18
RUNS = "array<struct<start: long, length: long, period: long>>"


_known_powers: dict[tuple[int, int, bool], np.ndarray] = {}


def _powers(size: int, p: int, inverse: bool) -> np.ndarray:
    """Powers 0 .. size / 2 - 1 of a root of unity of order size."""
    if (size, p, inverse) in _known_powers:
        return _known_powers[size, p, inverse]
    root = pow(GENERATOR, (p - 1) // size, p)
    root = pow(root, p - 2, p) if inverse else root
    out = np.ones(max(size // 2, 1), np.uint64)
    have = 1
    while have < len(out):
        out[have: 2 * have] = out[:have] * np.uint64(pow(root, have, p)) % np.uint64(p)
        have *= 2
    _known_powers[size, p, inverse] = out
    return out


def _transform(x: np.ndarray, p: int) -> np.ndarray:
    """Each row's number-theoretic transform, in bit-reversed order."""
    rows, size = x.shape
    m, half = np.uint64(p), size // 2
    while half:
        parts, w = x.reshape(rows, -1, 2, half), _powers(2 * half, p, False)
        a, b = parts[:, :, 0], parts[:, :, 1]
        x = np.stack([(a + b) % m, (a + m - b) * w % m], axis=2).reshape(rows, size)
        half //= 2
    return x


def _inverse(x: np.ndarray, p: int) -> np.ndarray:
    """The rows that ``_transform`` gives these rows for."""
    rows, size = x.shape
    m, half = np.uint64(p), 1
    while half < size:
        parts = x.reshape(rows, -1, 2, half)
        a, b = parts[:, :, 0], parts[:, :, 1] * _powers(2 * half, p, True) % m
        x = np.stack([(a + b) % m, (a + m - b) % m], axis=2).reshape(rows, size)
        half *= 2
    return x * np.uint64(pow(size, p - 2, p)) % m


def _differences(blocks: np.ndarray, windows: np.ndarray, p: int) -> np.ndarray:
    """Sums of squared differences modulo p of each block against its window, at the first B places."""
    m, size = np.uint64(p), blocks.shape[1]
    padded = np.zeros_like(windows)
    padded[:, :size] = blocks[:, ::-1]
    products = _inverse(_transform(windows, p) * _transform(padded, p) % m, p)[:, size - 1: 2 * size - 1]
    squares = np.zeros((len(windows), 2 * size + 1), np.uint64)
    np.cumsum(windows * windows % m, axis=1, out=squares[:, 1:])
    behind = squares[:, size: 2 * size] - squares[:, :size]
    own = (blocks * blocks % m).sum(axis=1, keepdims=True)
    return (own + behind + 2 * (m - products)) % m


def occurrences(ids: np.ndarray, starts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of all occurrences of the blocks at ``starts``, ``block`` to 2 ``block`` - 1 words on."""
    top = int(ids.max()) + 1
    text = np.concatenate([ids, np.full(3 * block, top)]).astype(np.uint64)  # a word that no block holds
    moduli, bound = [], 1
    while bound <= block * top * top:
        moduli.append(PRIMES[len(moduli)])
        bound *= moduli[-1]
    found = []
    for at in range(0, len(starts), max(BATCH // (2 * block), 1)):
        some = starts[at: at + max(BATCH // (2 * block), 1)]
        blocks = text[some[:, None] + np.arange(block)]
        windows = text[some[:, None] + np.arange(block, 3 * block)]
        equal = np.logical_and.reduce([_differences(blocks, windows, p) == 0 for p in moduli])
        row, place = np.nonzero(equal)
        found.append((some[row], place + block))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _same(ids: np.ndarray, at: int, distance: int, step: int) -> int:
    """How many words from ``at`` on, in steps of 1 or -1, equal the word ``distance`` behind them."""
    size, count = 64, 0
    while True:
        lo, hi = (at, min(at + size, len(ids) - distance)) if step > 0 else (max(at + 1 - size, 0), at + 1)
        if lo >= hi:
            return count
        unlike = np.flatnonzero(ids[lo:hi] != ids[lo + distance: hi + distance])
        if len(unlike):
            return count + (int(unlike[0]) if step > 0 else hi - lo - 1 - int(unlike[-1]))
        count, at, size = count + hi - lo, hi if step > 0 else lo - 1, 2 * size


def _stretches(ids: np.ndarray, seeds: np.ndarray, distance: int, block: int) -> list[tuple[int, int]]:
    """(start, end) of the longest stretches of period ``distance`` around the seeds (ascending) of blocks."""
    if len(seeds) * (8 * block + 4096) > len(ids):  # many seeds: one pass over the text
        same = np.concatenate([[False], ids[:-distance] == ids[distance:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        lows, highs = edges[::2], edges[1::2]
        held = np.unique(np.searchsorted(lows, seeds, "right") - 1)
        return list(zip(lows[held].tolist(), (highs[held] + distance).tolist()))
    out: list[tuple[int, int]] = []
    for seed in seeds.tolist():
        if not out or seed + block + distance > out[-1][1]:
            out.append((seed - _same(ids, seed - 1, distance, -1), seed + _same(ids, seed, distance, 1) + distance))
    return out


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers 0, 1, ..., by start, then period."""
    n = len(ids)
    if n >= MOST_WORDS:
        raise ValueError(f"a text has {n} words; transforms reach below {MOST_WORDS}")
    order = np.argsort(ids, kind="stable")
    gap = np.full(n, 4 * n + 1)
    again = ids[order[1:]] == ids[order[:-1]]
    gap[order[:-1][again]] = (order[1:] - order[:-1])[again]
    runs: dict[tuple[int, int], int] = {}
    cover = np.zeros(n, np.int64)  # the end of a run of smaller period that holds the word
    block = 1
    while MIN_REPEATS * block <= n:
        count = n // block - 1
        near = (gap[: count * block] < 2 * block).reshape(count, block).all(axis=1)
        starts = np.flatnonzero(near) * block
        starts = starts[cover[starts] < starts + 3 * block - 1]
        if len(starts):
            seeds, distances = occurrences(ids, starts, block)
            fresh = cover[seeds] < seeds + distances + block
            seeds, distances = seeds[fresh], distances[fresh]
            by = np.lexsort((seeds, distances))
            new = []
            for group in np.split(by, np.flatnonzero(np.diff(distances[by])) + 1) if len(by) else []:
                period = int(distances[group[0]])
                new += [(s, e, period) for s, e in _stretches(ids, seeds[group], period, block)
                        if e - s >= max(MIN_LENGTH, MIN_REPEATS * period)]
            for s, e, period in new:
                runs.setdefault((s, e), period)  # an earlier, smaller period has the same ends
                np.maximum(cover[s:e], e, out=cover[s:e])
        block *= 2
    return sorted((s, e - s, q) for (s, e), q in runs.items())


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period: start + length] = False
    return [words[i] for i in np.flatnonzero(kept)]


def text_runs(text: str | None) -> tuple[int, list[tuple[int, int, int]], str]:
    """Words, runs and the text without repeats, its words joined by one space."""
    words = (text or "").encode().split()  # splits at 20 and 09 to 0D, as no other byte of UTF-8 is white space
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    runs = find_runs(ids) if len(number) < len(words) else []
    return len(words), runs, b" ".join(without_repeats(words, runs)).decode()


def periodic_runs(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs (but columns named like the new ones) with n_words, runs and collapsed.

    ``runs`` holds (start, length, period), by start and period; ``collapsed`` the text without what runs
    repeat. A null text counts as empty: no words, no runs, an empty text. Rows are read one by one, so
    repeated rows get the same result, whatever their doc_id. An empty table gives an empty table. A text of
    ``MOST_WORDS`` words raises.
    """
    new = ["n_words", "runs", "collapsed"]
    own = [c for c in docs.columns if c not in new]
    at = own.index("text")
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_runs(text) for text in batch.column(at).to_pylist()]
            runs = [[{"start": s, "length": n, "period": q} for s, n, q in f[1]] for f in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.int64()), pa.array(runs, run_type),
                 pa.array([f[2] for f in found], pa.string())], [*own, *new])

    kept = docs.select(*own)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{schema}, n_words long, runs {RUNS}, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts whose doc_id has a crc32 divisible by 10 repeat from some word on; a null doc_id plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    spots = docs.withColumn("_words", F.when(h % 10 == 0, words)).withColumn("_g", F.floor(h / 10))
    spots = spots.withColumn("_n", F.size("_words")).withColumn("_a", F.expr("if(_n > 0, _g % _n, null)"))
    spots = spots.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    repeated = F.expr("concat_ws(' ', transform(sequence(0, _n - 1), i -> _words[int(if(i < _a, i, _a + (i - _a) % _p))]))")
    return spots.withColumn("text", F.when(F.col("_n") > 0, repeated).otherwise(F.col("text"))).select(*docs.columns)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of all documents, after the planting that the contract states."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(with_planted_runs(docs))
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length AS shortness, r.start AS start, r.period AS period)))")
    listed = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"),
        (-F.col("longest.shortness")).alias("length"), F.col("longest.period").alias("period"),
        F.expr("(-1000 * longest.shortness) div longest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
