"""SimHash: fingerprints and components against brute force; long lists, edge cases, the counting argument."""

import random
import re
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from gleaner.llm.simhash import fingerprint, fingerprint_links, first_masks, mask_tree, op12_simhash, simhash_components


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i: i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    """The least index that links of three bits reach, per entry."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def signed(fp):
    return fp - (1 << 64) if fp >> 63 else fp


def linked_parts(spark, fps, list_size):
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(3)
    root = {signed(f): signed(f) for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in fingerprint_links(frame, list_size).collect():
        root[max(find(e.a), find(e.b))] = min(find(e.a), find(e.b))
    return {f: find(signed(f)) for f in fps}


def same_parts(fps, got):
    want = components(fps)
    return all((want[i] == want[j]) == (got[fps[i]] == got[fps[j]]) for i, j in combinations(range(len(fps)), 2))


def test_documents_equal_brute_force(spark, sf_dir):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda d: d.doc_id)
    fps = [slow_fingerprint(d.text) for d in docs]
    want = {(d.doc_id, f"{f:016x}", docs[c].doc_id) for d, f, c in zip(docs, fps, components(fps))}
    got = op12_simhash(spark, sf_dir).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert len({r.component_id for r in got}) < len(got)


def test_random_fingerprints_and_long_lists(spark):
    draw = random.Random(5)
    fps = set()
    for _ in range(12):
        centre = draw.getrandbits(64)
        for _ in range(12):
            f = centre
            for bit in draw.sample(range(64), draw.randint(0, 6)):
                f ^= 1 << bit
            fps.add(f)
    # a dense cluster: all lists of its shared bytes are long
    dense = {0xABCDEF0123456789 ^ (a << 3) ^ (b << 17) for a in range(16) for b in range(4)}
    fps = sorted(fps | dense)
    for list_size in (1024, 8, 2):
        assert same_parts(fps, linked_parts(spark, fps, list_size))


def test_every_close_pair_shares_a_mask_at_every_depth():
    tree = mask_tree()
    masks = [m & (1 << 64) - 1 for m in tree]
    draw = random.Random(2)
    for _ in range(60):
        diff = sum(1 << b for b in draw.sample(range(64), draw.randint(1, 3)))
        level = [m for m in masks if m in {x & (1 << 64) - 1 for x in first_masks()}]
        while level:
            level = [m for m in level if not m & diff]
            assert level
            level = [x & (1 << 64) - 1 for m in level for x in tree[signed(m)]]
    assert {64 - m.bit_count() for m in masks if not tree[signed(m)]} == {12}


def test_edge_cases(docs_of):
    docs = docs_of([(7, None), (3, ""), (9, " \n"), (5, "Ab C"), (6, "ab c"), (6, "other words"), (None, "AB C"), (None, "alone text here now"),
                    (8, "word " * 60_000)])
    docs = docs.withColumn("fp", F.lit(1)).withColumn("n", F.lit("own")).withColumn("component_id", F.lit(0))
    got = [(r.doc_id, r.fingerprint, r.component_id, r.n_same) for r in simhash_components(docs).collect()]
    by = {(d, f): (c, n) for d, f, c, n in got}
    zero, abc = "0" * 16, f"{fingerprint('ab c'):016x}"
    assert len(got) == 9 and by[7, zero] == by[3, zero] == by[9, zero] == (3, 3)
    assert by[5, abc] == by[6, abc] == by[None, abc] == (5, 3)
    assert by[None, f"{fingerprint('alone text here now'):016x}"] == (None, 1)
    assert by[8, f"{fingerprint('word word word'):016x}"] == (8, 1)
    assert simhash_components(docs.where("doc_id < 0")).count() == 0


def test_chunks_do_not_change_fingerprints():
    words = [str(i % 977) for i in range(140_000)]
    assert fingerprint(" ".join(words)) == slow_fingerprint(" ".join(words))
    assert np.uint64(fingerprint("İ Kelvin K")) == slow_fingerprint("İ Kelvin K")
