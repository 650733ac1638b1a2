"""Periodic runs: every run against brute force, planted texts, edge cases, hostile texts in near-linear time."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from gleaner.llm.periodic_runs import find_runs, occurrences, op13_periodic_runs, periodic_runs


def all_runs(words):
    """Stretches of each period in turn; the first period of a stretch is its smallest one."""
    seen, out = set(), []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and (i, j + q) not in seen:
                seen.add((i, j + q))
                if j + q - i >= max(6, 4 * q):
                    out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out)


def numbers(words):
    known = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def test_runs_equal_brute_force():
    draw = random.Random(7)
    for _ in range(1500):
        n, kinds = draw.randint(1, 120), draw.choice([1, 2, 3, 6])
        words = [draw.randrange(kinds) for _ in range(n)]
        for _ in range(draw.randint(0, 3)):
            a, p = draw.randrange(n), draw.randint(1, max(1, n // 4))
            for i in range(a, min(n, a + draw.randint(0, 6 * p))):
                words[i] = words[a + (i - a) % p]
        assert find_runs(numbers(words)) == all_runs(words)


def test_occurrences_are_exact_for_large_numbers():
    ids = np.random.default_rng(3).integers(0, 40_000, 256)
    ids[100:108] = ids[8:16] = ids[0:8]
    found = occurrences(ids, np.arange(0, 240, 8), 8)
    assert (0, 8) in zip(*(f.tolist() for f in found))
    assert all((ids[s: s + 8] == ids[s + d: s + d + 8]).all() for s, d in zip(*found))
    far = occurrences(ids, np.array([0]), 64)  # 64 to 127 words on: the copy at 100 is of 8 words only
    assert not len(far[0])


def test_documents_equal_brute_force(spark, sf_dir):
    got = {r.doc_id: r for r in op13_periodic_runs(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        words, h = re.findall(r"[^\x20\x09-\x0D]+", d.text or ""), zlib.crc32(str(d.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs, r = all_runs(words), got[d.doc_id]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{x},{q}\n" for s, x, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert sum(r.n_runs > 0 for r in got.values()) > 5


def test_edge_cases_and_clashing_columns(spark):
    rows = [(1, None, 5), (2, "", 5), (3, " \t\n", 5), (4, "a " * 6, 5), (4, "a " * 6, 5), (None, "x a b a b a b a b y", 5),
            (5, "a  a  a  a  a  a  a ", 5), (6, "a a a a a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumn("collapsed", F.lit("own")).withColumn("_p", F.lit(1))
    out = periodic_runs(docs).orderBy("doc_id").collect()
    assert [[tuple(x) for x in r.runs] for r in out] == [[(1, 8, 2)], [], [], [], [(0, 6, 1)], [(0, 6, 1)], [(0, 7, 1)], []]
    assert [r.collapsed for r in out] == ["x a b y", "", "", "", "a", "a", "a ", "a a a a a"]
    assert out[0]._p == 1 and periodic_runs(docs.where("doc_id < 0")).count() == 0


def test_long_texts_full_of_runs():
    i = np.arange(700_000)
    assert len(find_runs(numbers(np.where(i % 7 < 6, -1, i).tolist()))) == 100_000
    assert find_runs(np.zeros(400_000, np.int64)) == [(0, 400_000, 1)]
    assert find_runs(np.arange(600_000) % 150_000) == [(0, 600_000, 150_000)]
    assert find_runs(np.arange(600_000) % 1000) == [(0, 600_000, 1000)]
