"""Quality rules: base counts against plain code, the ratio against its formula, held-out accuracy."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    held = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i:i + 3])] > 1}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 50 or 100 * len(held) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(held), failed


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab é#|\n\t\x1c\x85\x0b日"), max_size=60))
def test_base_counts_equal_plain_code(text):
    assert q.base_counts(text, text.encode().split()) == plain(text)


def test_all_documents(spark, sf_dir):
    """Counts by plain code; verdicts from models counted over all texts in one process."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    grams = {d: q.ngram_buckets((t or "").encode(), (t or "").encode().split()) for d, t in docs.items()}
    raw = sum(np.bincount(g, minlength=q.BUCKETS) for g in grams.values())
    half = {d for d in labels if zlib.crc32(str(d).encode()) % 2 == 0}
    target = sum(np.bincount(grams[d], minlength=q.BUCKETS) for d in half if labels[d] == 1 and d in docs)
    ratio = q.log_ratio(raw.astype(float), target.astype(float))
    score = {d: ratio[g].mean() if len(g) else 0.0 for d, g in grams.items()}
    cut = sorted((score[d], v) for d, v in labels.items() if d in docs and d not in half and not plain(docs[d])[-1])
    threshold = q.best_threshold(np.array([s for s, _ in cut]), np.array([v == 1 for _, v in cut]))
    rows = q.op5_quality(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        want = plain(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert r.kept == (not want[-1] and score[r.doc_id] >= threshold)


def test_held_out_accuracy(spark):
    """Fitted on half the labels, the verdict keeps the good and rejects the poor of the other half."""
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    model = q.fit(docs, labels.where(F.xxhash64("doc_id") % 2 == 0))
    held = q.judge(docs, model).join(labels.where(F.xxhash64("doc_id") % 2 != 0), "doc_id").where("not base_failed").select(
        "kept", "quality").collect()
    good = [r.kept for r in held if r.quality == 1]
    poor = [not r.kept for r in held if r.quality == 0]
    assert np.mean(good) >= 0.99, np.mean(good)
    assert np.mean(poor) >= 0.95, np.mean(poor)


def test_edge_cases(spark, docs_of):
    long = " ".join(f"w{i}" for i in range(40_000))
    docs = docs_of([(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, long), (None, long)]).withColumn("kept", F.lit("x"))
    labels = spark.createDataFrame([(4, 1, 0), (3, 0, 0), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    rows = q.judge(docs, q.fit(docs, labels)).collect()
    assert len(rows) == 6 and [r.kept for r in rows if r.doc_id in (1, 2, 3)] == [False] * 4
    assert [r.n_words for r in rows if r.text == long] == [40_000] * 2
    none = docs.where("doc_id < 0")
    assert q.judge(none, q.fit(none, labels.where("false"))).count() == 0


@pytest.mark.parametrize("good", [[True, True], [False, False]])
def test_one_kind_of_label_rejects_nothing(good):
    assert q.best_threshold(np.array([0.0, 1.0]), np.array(good)) == -np.inf
