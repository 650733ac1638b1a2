"""Publishing: notes that were written go to the vault, the ledger records it; failed rows come up again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import values as V
from gleaner.operators.aggregates import reset_failed
from gleaner.operators.ledger import publish
from gleaner.operators.selection import select_items
from gleaner.sources.tables import write_note_files


def publish_posts(ledger: DataFrame, notes: DataFrame, vault: str, moved_at: Column) -> DataFrame:
    """Copy the notes of posts that are not in the vault yet; returns the ledger with them marked.

    ``ledger(slug, content_type, file_path, …)``, ``notes(path, content)``. Blog posts and glossary pages have a
    folder each; a row whose note is missing stays as it is.
    """
    folder = F.when(F.col("content_type") == "glossary", "Databricks Glossary").otherwise("Databricks")
    target = F.concat(folder, F.lit("/"), F.substring_index("file_path", "/", -1))
    moves, after = publish(ledger, notes, target, moved_at, ["slug"])
    files = notes.join(moves.select(F.col("file_path").alias("path"), "target"), "path")
    write_note_files(files.select(F.col("target").alias("path"), "content"), vault)
    return after


def retry_failed(ledger: DataFrame, source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(ledger, pending)``: the ledger with its failed rows reset, and all rows that now wait for a run."""
    reset = reset_failed(ledger, source)
    return reset, select_items(reset, V.PENDING, source)
