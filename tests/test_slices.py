"""A batch is read in slices: few rows are Python objects at a time, the result is that of the whole batch."""

import pyarrow as pa
import pytest

from gleaner.llm import quality
from gleaner.operators import html_blocks as helper


@pytest.mark.parametrize("rows", [0, 1, 64, 65, 1000])
def test_batches_are_read_in_bounded_slices(rows):
    seen = []

    def read(texts, names):
        seen.append(len(texts))
        return pa.array([None if t is None else [t + n] for t, n in zip(texts.to_pylist(), names.to_pylist())], pa.list_(pa.string()))

    texts, names = [None if i % 5 == 0 else f"t{i}" for i in range(rows)], [f"n{i}" for i in range(rows)]
    got = helper.in_slices(read, pa.array(texts, pa.string()), pa.array(names, pa.string()))
    assert got.to_pylist() == [None if t is None else [t + n] for t, n in zip(texts, names)]
    assert got.type == pa.list_(pa.string()) and max(seen) <= helper.SLICE_ROWS and sum(seen) == rows


def test_quality_reads_slices():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(200))})
    parts = list(quality.slices(iter([batch, batch.slice(0, 0), batch.slice(0, 3)])))
    assert max(p.num_rows for p in parts) <= quality.SLICE_ROWS
    assert [v for p in parts for v in p.column(0).to_pylist()] == [*range(200), 0, 1, 2]
