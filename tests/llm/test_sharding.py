"""Rendezvous shards against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gleaner.llm.sharding import op6_sharding, shard


def best(key, weights):
    def score(i):
        return -math.log((int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16) + 1) / 2**52) / weights[i]
    return min(range(len(weights)), key=score)


def test_all_documents_equal_brute_force(spark, sf_dir):
    rows, slots = op6_sharding(spark, sf_dir).collect(), defaultdict(list)
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "key")
        assert (r.shard, r.grown_shard) == (best(r.doc_id, [1] * 16), best(r.doc_id, [1] * 17))
        assert r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_and_few_moves(docs_of):
    docs = docs_of([(i, "t") for i in range(4000)])
    rows = shard(docs, [1.0, 2.0, 5.0]).collect()
    share = Counter(r.shard for r in rows)
    assert abs(share[2] / 4000 - 5 / 8) < 0.03 and abs(share[0] / 4000 - 1 / 8) < 0.03
    assert abs(sum(r.grown_shard == 3 for r in rows) / 4000 - 1 / 9) < 0.03


def test_edge_cases(docs_of):
    docs = docs_of([(1, None), (1, ""), (1, "é"), (None, "x"), (2, "y" * 100_000)])
    clashing = ["_rank", "_order", "_bucket", "_start", "_n", "_others"]
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in clashing} | {"size": F.lit("old"), "shard": F.lit("old"), "slot": F.lit("old")})
    rows = shard(docs, [1.0] * 4).collect()
    assert all(r[c] == f"own {c}" for r in rows for c in clashing)
    assert sorted(r.size for r in rows) == [1, 1, 2, 3, 100_001]
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1
    for s in {r.shard for r in rows}:
        held = sorted(r.slot for r in rows if r.shard == s)
        assert held == list(range(len(held)))
    assert shard(docs.where("doc_id < 0"), [1.0]).count() == 0
    with pytest.raises(ValueError):
        shard(docs, [1.0, 0.0])
