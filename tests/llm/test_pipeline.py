"""The pipeline against the same decisions by plain code, and its stages on odd tables."""

from collections import Counter

import pytest

import corpus_pipeline as cp
from gleaner.llm import quality as q
from gleaner.llm.common import documents
from tests.llm.test_ngram_jaccard import brute
from tests.llm.test_tokens import check_pieces


def test_rows_equal_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in q.op5_quality(spark, sf_dir).collect() if r.kept}
    first = {}
    for d in sorted(good):
        first.setdefault(rows[d], d)
    left = {d: rows[d] for d in first.values()}
    groups = brute(list(left.items()), 5, 80, 100)
    left = [(d, t) for d, t in left.items() if groups[d][1] == d]
    got = cp.run(spark, sf_dir).collect()
    check_pieces(left, got, 2048)


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_stages_on_odd_rows_and_no_rows(spark, docs_of, sf_dir, name, stage):
    text = " ".join(f"w{i}" for i in range(60))
    docs = docs_of([(1, text), (1, text), (2, text, None), (3, None), (4, ""), (None, text), (5, text + " end", "other")])
    out = stage(spark, docs, sf_dir)
    ids = Counter(r.doc_id for r in out.collect())
    if name in ("mixture", "packing"):
        assert ids == Counter([1, 1, 2, 3, 4, None, 5])
    elif name == "quality":
        assert set(ids) <= {1, 2, None, 5}
    elif name == "exact_copies":
        assert ids == Counter([1, 3, 5])
    else:
        assert set(ids) == {1, 3, 4, None}
    if name != "packing":
        assert out.columns == docs.columns
    assert stage(spark, docs.where("doc_id < 0"), sf_dir).count() == 0
