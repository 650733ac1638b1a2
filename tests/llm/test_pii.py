"""Personal data: base spans against other code, the recursion against all segmentations."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from gleaner.llm import pii


def plain(text):
    found = []
    for rank, pattern in enumerate([
            r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = [True, all(int(p) <= 255 for p in m.group().split(".")) if rank == 1 else True, 12 <= len(digits) <= 19, 9 <= len(digits) <= 15][rank]
            if rank == 2 and ok:
                total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1]))
                ok = total % 10 == 0
            if ok:
                found.append((m.start(), rank, m.end(), pii.KINDS[rank]))
    return sorted(found)


CASES = ["", "a@b.c@d.e", "a@b.c_d@e.f x.y+z@host.example.com,", "1.2.3.4.5.6.7.8 256.1.1.1 0255.01.1.1", "4111 1111-1111 1111 4111111111111112",
         "+1 (803) 555-5351 +12 +1((((((((2 +123456789 1", "é日 +44.20.7946.0958.", "@ @@ a@ @b a@b", "x\x0ba@b.co\x0c1.1.1.1\n", "4" * 40]


@pytest.mark.parametrize("text", CASES)
def test_base_spans_equal_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_all_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = pii.fit(docs)
    rows = pii.find(docs, model).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == k for s in want) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(pii.listing(want).encode()).hexdigest()
        assert set(pii.listing(want).split(",")) <= set(r.spans.split(","))
        ends = sorted(tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s)
        added = len(ends) - len(want)
        assert added == 0 or all(s[1] - s[0] >= 7 for s in ends)


def test_recursion_equals_all_segmentations():
    rng = np.random.default_rng(0)
    region = pii.regions("call 803 555 5351 12 3456")[0]
    assert len(region.pieces) == 5
    n = len(region.pieces)
    model = {name: rng.normal(size=4) for i in range(n) for j in range(i + 1, n + 1) for name in pii.features(region, i, j)}
    scores = pii.segment_scores(region, model)

    def ways(i):
        if i == n:
            yield 0.0, ()
            return
        for s, rest in ways(i + 1):
            yield s, rest
        for j in range(i + 1, n + 1):
            for kind in range(4):
                for s, rest in ways(j):
                    yield s + scores[i, j][kind], ((i, j, kind), *rest)

    everything = list(ways(0))
    assert tuple(pii.decode(region, model)) == max(everything)[1]
    gold = set(max(everything)[1])
    known = {(i, j): pii.features(region, i, j) for i, j in scores}
    total = np.logaddexp.reduce([s for s, _ in everything])
    slope = pii.gradient(region, gold, model, known)
    for name in itertools.islice(slope, 6):
        for kind in range(4):
            want = sum(name in known[i, j] and k == kind for i, j, k in gold) - sum(
                np.exp(s - total) * sum((name in known[i, j]) and k == kind for i, j, k in segs) for s, segs in everything)
            assert abs(slope[name][kind] - want) < 1e-8


def test_other_writings_are_found_and_plain_numbers_left_alone():
    base = [f"word call +1 ({300 + i}) 555-{1000 + 7 * i} then mail a{i}@mail.example.com at 10.{i}.3.{i} or {2531585014589253 + 11 * i}" for i in range(60)]
    model = pii.train(base)
    spans = pii.all_spans("please call (803) 555-5351 now", model)[1]
    assert [(s[3], s[0], s[2]) for s in spans] == [("phone", 12, 26)]
    for clean in ("in 2019 and 2020 we sold 1234 of 5678", "the year 1999.", "page 12 of 340", "nothing here"):
        assert pii.all_spans(clean, model)[1] == []


def test_edge_cases(docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "a@b.co"), (3, "a@b.co"), (None, "1.1.1.1"), (4, "x " * 100_000 + "+1 234 567 890 12")])
    rows = pii.find(docs, pii.fit(docs)).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.n_ip, r.n_phone) for r in rows) == [
        (0, 0, 1, 0), (1, 0, 0, 0), (2, 0, 0, 0), (3, 1, 0, 0), (3, 1, 0, 0), (4, 0, 0, 1)]
    assert pii.find(docs.where("doc_id < 0"), pii.fit(docs.where("doc_id < 0"))).count() == 0


def test_long_words_and_many_spans_take_linear_time():
    draw = random.Random(4)
    alphabet = ["a", ".", "@", "-", "b.c", "%", "x@y.z", " "]
    for _ in range(3000):
        chunk = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 14)))
        assert list(pii.emails(chunk)) == [m.span() for m in pii._EMAIL.finditer(chunk)], chunk
    start = time.perf_counter()
    for text in ("a" * 300_000, "a" * 300_000 + "@", "a@" * 150_000, "@a" * 150_000, "a.b@c.de," * 40_000):
        pii.base_spans(text)
    base, _ = pii.all_spans("call +1 (555) 010-9999 now, mail a.b@c.de " * 20_000, pii.train(["call +1 (555) 010-9999 or a@b.cd"]))
    assert len(base) == 40_000 and time.perf_counter() - start < 60
