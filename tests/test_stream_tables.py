"""The streaming queries over tables that are one file and over tables that are a folder of files."""

import pytest

from gleaner.catalog.stream_queries import r04


@pytest.mark.parametrize("files", [0, 3])
def test_chapter_marks_of_a_file_and_of_a_folder(spark, tmp_path, files):
    rows = spark.createDataFrame([(c, t, "user", "x") for c in range(5) for t in range(c + 1)], "conv_id long, turn long, role string, text string")
    path = tmp_path / "conversations.parquet"
    if files:
        rows.repartition(files).write.parquet(str(path))
    else:
        rows.toPandas().to_parquet(path)
    rows.limit(0).write.parquet(str(tmp_path / "other.parquet"))
    assert {(r.conv_id, r.high) for r in r04(spark, str(tmp_path)).collect()} == {(c, c + 1) for c in range(5)}
