"""The Jaccard join against all pairs, and its edge cases."""

import random
from itertools import combinations

import numpy as np
import pytest

from gleaner.llm import components
from gleaner.llm import ngram_jaccard as nj
from gleaner.llm.components import connected_components


def brute(rows, n, num, den):
    """Components by comparing all pairs of word n-gram sets."""
    sets = {}
    for doc, text in rows:
        words = text.encode().lower().split() if text else []
        width = min(n, len(words))
        sets[doc] = {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if words else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = [d for d in sets if sets[d]]
    for a, b in combinations(held, 2):
        if min(len(sets[a]), len(sets[b])) * den < max(len(sets[a]), len(sets[b])) * num:
            continue
        both = len(sets[a] & sets[b])
        if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_all_documents_equal_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(nj.op1_ngram_jaccard(spark, sf_dir)) == brute(rows, 4, 85, 100)


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80)])
def test_families_of_near_copies_equal_brute_force(docs_of, n, num):
    """Copies of copies around the threshold, of many lengths: links that no common leader has."""
    rng, rows = random.Random(n), []
    for family, size in enumerate([5, 7, 9, 14, 23, 40, 75, 150, 300]):
        base = [f"w{family}_{i}" for i in range(size)]
        versions = [base]
        for _ in range(24):
            words = list(rng.choice(versions))
            for _ in range(rng.randint(0, max(1, size // 40))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.4:
                words = words[: len(words) - rng.randint(0, max(1, size // 20))]
            versions.append(words)
        rows += [" ".join(v) for v in versions]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want = brute(rows, n, num, 100)
    assert got(nj.jaccard_components(docs_of(rows), n, num, 100)) == want
    assert 1 < len({c for _, c in want.values()}) < len(rows)


def test_small_cells_keep_every_link(docs_of, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_ROWS", 7)
    monkeypatch.setattr(nj, "BIN_ROWS", 50)
    rng = random.Random(5)
    chain, rows = [f"a{i}" for i in range(60)], []
    for i in range(80):
        chain = list(chain)
        chain[rng.randrange(60)] = f"b{i}"
        rows.append((i, " ".join(chain)))
    assert got(nj.jaccard_components(docs_of(rows), 4, 85, 100)) == brute(rows, 4, 85, 100)


def test_edge_cases(docs_of):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\x0btwo"), (6, "one two three"),
            (7, "one two three"), (8, "É a b c"), (9, "é a b c"), (10, "w " * 30000), (11, "w " * 3)]
    assert got(nj.jaccard_components(docs_of(rows), 4, 85, 100)) == {
        1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6), 8: (1, 8), 9: (1, 9),
        10: (1, 10), 11: (1, 11)}


def test_repeated_rows_null_ids_and_empty_table(docs_of):
    text = " ".join(f"w{i}" for i in range(30))
    assert got(nj.jaccard_components(docs_of([(1, text), (1, text), (2, text), (None, text)]))) == {
        1: (26, 1), 2: (26, 1), None: (26, None)}
    assert got(nj.jaccard_components(docs_of([(1, "x")]).where("doc_id < 0"))) == {}


def test_every_similar_pair_shares_a_signature():
    rng, bands = np.random.default_rng(3), nj.Bands(85, 100)
    for size in (6, 8, 13, 20, 33, 57, 120, 400):
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            b = a.copy()
            for i in rng.integers(0, size, max(1, int(size * 0.075))):
                b[i] = rng.integers(0, 2**63, dtype=np.uint64)
            b = np.unique(b)
            if nj.similar(a, b, 85, 100):
                assert len(np.intersect1d(nj.signatures(a, bands), nj.signatures(b, bands)))


def test_pairs_at_the_threshold_meet_whatever_cover_each_side_takes():
    rng = np.random.default_rng(9)
    bands, covers = nj.Bands(80, 100), 0
    for size in [*range(1, 60), *range(60, 500, 11)]:
        for _ in range(4):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            part = a[: -(-len(a) * 80 // 100)]  # the smallest subset that links
            swap = len(a) // 9  # as many elements exchanged as a link allows
            other = np.unique(np.r_[a[swap:], rng.integers(0, 2**63, swap, dtype=np.uint64)])
            for b in (part, other):
                assert nj.similar(a, b, 80, 100)
                assert len(np.intersect1d(nj.signatures(a, bands), nj.signatures(b, bands)))
            covers += len(nj.signatures(a, bands)) / len(a) < 1
    assert covers > 100  # sets of some size need fewer signatures than they have elements


@pytest.mark.parametrize("edges_per_task", [7, 500_000])
def test_components_of_long_chains(spark, monkeypatch, edges_per_task):
    monkeypatch.setattr(components, "EDGES_PER_TASK", edges_per_task)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (None, 5), (201, 200)], "a long, b long")
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert found == {**{i: 0 for i in range(61)}, 200: 200, 201: 200}


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    for size in (1, 6, 31, 32, 64, 200, 1000):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        for change in range(0, max(2, size // 5)):
            b = np.unique(np.r_[a[change // 2:], rng.integers(0, 2**63, change - change // 2, dtype=np.uint64)])
            x, y = nj.sketch(a)[None], nj.sketch(b)[None]
            words = min(x.shape[1], y.shape[1])
            differ = np.bitwise_count(nj.folded(x, words) ^ nj.folded(y, words)).sum()
            assert differ <= len(np.setxor1d(a, b))
            assert nj.may_link(differ, len(a), len(b), 85, 100) or not nj.similar(a, b, 85, 100)
