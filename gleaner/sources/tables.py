"""Ledger tables, run logs, notes and reports on storage.

Parquet tables have no in-place update: a changed ledger is a new snapshot at a new
path, and logs only append.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import extract
from gleaner.sources.note_files import folder_of, inside, read_note_files, write_note_files  # noqa: F401 - note files are a sink like the others here


def read_ledger(spark: SparkSession, path: str, source: str | None = None, schema: str | None = None) -> DataFrame:
    """Ledger rows, of one source if named: a partition filter, or a pushed-down one.

    With a schema no footer is read ahead; columns that older files lack are null. Without one the
    footers of all files are merged. Snapshots from before the ``content_type`` column read as blogs.
    """
    ledger = spark.read.schema(schema).parquet(path) if schema else spark.read.option("mergeSchema", "true").parquet(path)
    if "content_type" in ledger.columns:
        ledger = ledger.withColumn("content_type", F.coalesce("content_type", F.lit("blog")))
    return ledger.filter(F.col("source") == source) if source else ledger


def _by_source(frame: DataFrame) -> DataFrame:
    """Rows gathered by source into files of even size.

    Rebalancing splits a source that holds a large share of the rows over several tasks
    and merges small ones, so that tasks do not each write a sliver of every source.
    """
    return frame.hint("rebalance", "source")


def write_ledger(ledger: DataFrame, path: str) -> None:
    """A new snapshot, one folder per source."""
    _by_source(ledger).write.partitionBy("source").parquet(path)


def write_notes(notes: DataFrame, path: str) -> None:
    """``(source, path, content)`` rows as a Parquet table by source."""
    _by_source(notes.select("source", "path", "content")).write.partitionBy("source").parquet(path)


def write_line_files(lines: DataFrame, root: str, sep: str = "\n") -> None:
    """One file per ``path`` of ``lines(path, ord, line)``, its lines in order, as one stream of any length.

    A file takes its place when it is complete; a task that is killed leaves no half file there.
    """
    root = folder_of(root)

    def save(rows: Iterable) -> None:
        for path, own in groupby(rows, key=lambda r: r["path"]):
            target = inside(root, path)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=os.path.dirname(target), prefix=".", delete=False) as file:
                for i, row in enumerate(own):
                    file.write((sep if i else "") + row["line"])
                file.write("\n")
            os.replace(file.name, target)

    lines.select("path", "ord", "line").repartition("path").sortWithinPartitions("path", "ord").foreachPartition(save)


def vault_rows(files: DataFrame) -> DataFrame:
    """``(novel, num, path)`` of chapter files ``…/Novel/0001 - Novel.md``, imported as moved."""
    name = F.substring_index("path", "/", -1)
    folder = F.substring_index(F.substring_index("path", "/", -2), "/", 1)
    num = extract(name, r"^(\d{4}) - .*\.md$").cast("long")
    return files.select(
        folder.alias("novel"), num.alias("num"), "path",
        F.lit("imported").alias("site"), F.lit("unknown").alias("status"), F.lit(True).alias("in_obsidian"),
    ).filter(F.col("num").isNotNull())


def scan_vault(spark: SparkSession, root: str) -> DataFrame:
    """Chapter files of a vault folder; only names are read, no contents."""
    names = read_note_files(spark, root, contents=False)
    return vault_rows(names.select(F.concat(F.lit(f"{root.rstrip('/')}/"), "path").alias("path")))


def to_json_report(frame: DataFrame) -> DataFrame:
    """Each row as one JSON text; null fields stay, other types read as strings."""
    plain = [
        F.col(name) if kind in ("string", "boolean", "int", "bigint", "double") or kind.startswith("array")
        else F.col(name).cast("string").alias(name)
        for name, kind in frame.dtypes
    ]
    return frame.select(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}).alias("json"))


def append_run_log(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").parquet(path)
