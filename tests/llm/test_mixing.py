"""The Pfair mixture: against an unaided scheduler, and its bound on the deviation."""

from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from gleaner.llm.mixing import mix, source_parts, write_order


def brute(parts, blocks, period):
    """Slots of each source's blocks by earliest deadline first, one slot after the other."""
    done, out, slot = Counter(), defaultdict(list), 0
    while any(done[s] < blocks[s] for s in parts):
        ready = [(-(-(done[s] + 1) * period // a), s) for s, a in parts.items() if done[s] * period // a <= slot]
        due, pick = min(ready)
        assert slot < due, "a deadline is missed"
        out[pick].append(slot)
        done[pick] += 1
        slot += 1
    return {s: out[s][: blocks[s]] for s in parts}


@pytest.mark.parametrize("targets,period,block_rows", [(None, 100, 3), ({"a": 6, "b": 3, "c": 1}, 50, 2), ({"a": 0.9}, 17, 1)])
def test_schedule_equals_brute_force(docs_of, targets, period, block_rows):
    sizes = {"a": 120, "b": 70, "c": 33, "": 5}
    ids = iter(range(10**6))
    docs = docs_of([(next(ids), "t", s or None) for s, n in sizes.items() for _ in range(n)])
    parts = {r.source: r.parts for r in source_parts(docs, targets, 0.5, period).collect()}
    assert sum(parts.values()) == period
    rows = mix(docs, targets, 0.5, period, block_rows).collect()
    assert len(rows) == sum(sizes.values())
    slots = defaultdict(dict)
    for r in rows:
        slots[r.source or ""][r.block] = r.slot
        assert r.release <= r.slot < r.deadline
    want = brute(parts, {s: -(-n // block_rows) for s, n in sizes.items()}, period)
    assert {s: [v for _, v in sorted(b.items())] for s, b in slots.items()} == want
    assert sorted(r.position for r in rows) == list(range(len(rows)))
    order = sorted(rows, key=lambda r: r.position)
    assert [r.slot for r in order] == sorted(r.slot for r in rows)
    # until the first source runs out, no source is a block or more away from its weight
    first_end = min(max(b.values()) for b in slots.values())
    for slot in range(first_end + 1):
        for s, a in parts.items():
            had = sum(v <= slot for v in slots[s].values())
            assert abs(had - Fraction(a * (slot + 1), period)) < 1


def test_written_order_and_repeats(docs_of):
    docs = docs_of([(i % 5, "same", "s") for i in range(20)] + [(None, None, None), (99, "", "t")])
    clashing = ["release", "parts", "before", "ordinal", "_tie", "turn", "cycle", "_order", "_bucket", "_source", "_others", "a.b"]
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in clashing})
    mixed = mix(docs.withColumns({"slot": F.lit("old"), "position": F.lit("old")}))
    rows = mixed.collect()
    assert mixed.count() == 22 and {r.position for r in rows} == set(range(22))
    assert all(r[c] == f"own {c}" for r in rows for c in clashing if c != "release")
    plain = {(r.doc_id, r.position) for r in mix(docs.select("doc_id", "source", "text")).collect()}
    assert {(r.doc_id, r.position) for r in rows} == plain
    out = write_order(mixed, docs.columns)
    assert out.columns == docs.columns and out.count() == 22


def test_empty_table_and_too_many_sources(docs_of):
    docs = docs_of([(i, "t", f"s{i}") for i in range(4)])
    assert mix(docs.where("doc_id < 0")).count() == 0
    with pytest.raises(ValueError):
        mix(docs, period=3)
