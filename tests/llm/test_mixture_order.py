"""The mixture's order: in the written files, and in the sequences that the next stage packs."""

import corpus_pipeline as cp
from gleaner.llm.common import file_order, staged
from gleaner.llm.mixing import mix


def test_written_files_and_packed_rows_follow_the_mixed_order(spark, docs_of, sf_dir):
    docs = docs_of([(i, "one two three", "a" if i < 300 else "b") for i in range(400)])
    want = [r.doc_id for r in mix(docs).orderBy("position").collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        written = staged(cp.mixture(spark, docs, sf_dir), "mixture")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(written.inputFiles()) > 1
    read = written.select("doc_id", file_order().alias("at")).collect()
    assert [r.doc_id for r in sorted(read, key=lambda r: r.at)] == want
    packed = cp.packing(spark, written, sf_dir).collect()
    assert len({r.length for r in packed}) == 1
    assert [r.doc_id for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset))] == want
    other = cp.packing(spark, staged(docs, "unmixed"), sf_dir).collect()
    assert [r.doc_id for r in sorted(other, key=lambda r: (r.sequence_id, r.offset))] != want
