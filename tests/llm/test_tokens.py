"""Token ids, token files and packing against the tokenizers library, one text at a time."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gleaner.llm import packing, token_files
from gleaner.llm.tokens import WordIds, default_path

TOKENIZER = Tokenizer.from_file(default_path())
WORDS = WordIds(default_path())
ROWS = [(1, None), (2, ""), (3, " \n\t"), (5, "Hello, WORLD! it's <|endoftext|>x \x01 done"), (4, "é́ Ünï 日本  x\x1cy"),
        (7, "the " * 9000), (8, "a"), (8, "b"), (None, "no id"), (9, "same"), (10, "same")]


def ids(text, end):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, end]


def crc(found):
    return zlib.crc32(np.array(found, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=5))
def test_words_give_the_ids_of_the_whole_text(texts):
    found, limits = WORDS.encode(texts, 7)
    assert [found[a:b].tolist() for a, b in zip(limits, limits[1:])] == [ids(t, 7) for t in texts]


def test_all_documents_give_the_library_s_ids(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found, limits = WORDS.encode(texts, 1)
    assert [found[a:b].tolist() for a, b in zip(limits, limits[1:])] == [ids(t, 1) for t in texts]


def test_the_memory_is_bounded(monkeypatch):
    monkeypatch.setitem(WordIds.encode.__globals__, "REMEMBERED_WORDS", 3)
    words = WordIds(default_path())
    for i in range(5):
        assert words.encode([f"alpha{i} beta gamma"], 0)[0].tolist() == ids(f"alpha{i} beta gamma", 0)
    assert len(words.index) <= 6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=40))
def test_byte_code_round_trip(values):
    control, data = token_files.pack(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert token_files.unpack(control, data, len(values)).tolist() == values


def expected_files(rows):
    start, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        found = ids(text, 1)
        out.append((doc, start, len(found), crc(found)))
        start += len(found)
    return out


@pytest.mark.parametrize("block", [1, 3, 256])
def test_token_files_round_trip(spark, docs_of, tmp_path, block):
    folder = f"{tmp_path}/f"
    token_files.write_token_files(docs_of(ROWS), folder, docs_per_block=block)
    got = token_files.read_token_files(spark, folder, with_ids=True).collect()
    assert sorted([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got], key=lambda r: r[1]) == expected_files(ROWS)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(len(ranks))) and all(a["count"] >= b["count"] for a, b in zip(ranks, ranks[1:]))


def test_op4_equals_the_library(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = token_files.op4_token_files(spark, sf_dir).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected_files(rows)


def test_empty_file_set(spark, docs_of, tmp_path):
    token_files.write_token_files(docs_of([(1, "a")]).where("doc_id < 0"), f"{tmp_path}/f")
    assert token_files.read_token_files(spark, f"{tmp_path}/f").count() == 0


def one_by_one(lengths, capacity):
    """Best-fit decreasing, an item at a time: how many bins there are of each filling."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=120), st.integers(30, 45))
def test_histogram_packing_equals_placing_one_by_one(lengths, capacity):
    counts = {n: lengths.count(n) for n in lengths}
    runs, used = packing.best_fit_decreasing(counts, capacity), defaultdict(int)
    for n, total in counts.items():
        firsts = sorted((first, b, each, at) for length, first, b, each, at in runs if length == n)
        for (first, b, each, at), last in zip(firsts, [f[0] for f in firsts[1:]] + [total]):
            for number in range(first, last):
                i = number - first
                used[b + i // each] += n
    assert sorted(capacity - u for u in used.values()) == one_by_one(lengths, capacity)


def check_pieces(rows, got, capacity):
    want = {}
    for doc, text in rows:
        found = ids(text, 0)
        for piece, at in enumerate(range(0, len(found), capacity)):
            part = found[at: at + capacity]
            want.setdefault((doc, piece), []).append((at, len(part), crc(part)))
    have, bins = defaultdict(list), defaultdict(list)
    for r in got:
        have[r.doc_id, r.piece].append((r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    assert sorted(capacity - sum(n for _, n in b) for b in bins.values()) == one_by_one([r.length for r in got], capacity)


def test_op8_equals_placing_one_by_one(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_pieces(rows, packing.op8_packing(spark, sf_dir).collect(), 2048)


def test_packing_edge_cases(docs_of):
    check_pieces(ROWS, packing.pack_documents(docs_of(ROWS), capacity=64).collect(), 64)
    placed = packing.pack_documents(docs_of(ROWS), capacity=64, with_ids=True)
    for r in packing.sequences(placed).collect():
        assert len(r.ids) == 4 * r.length <= 256
    assert packing.pack_documents(docs_of([(1, "a")]).where("doc_id < 0")).count() == 0
    with pytest.raises(ValueError):
        packing.best_fit_decreasing({10: 1}, 9)
