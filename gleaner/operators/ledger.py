"""Ledger state: outcomes, status changes, publishing, indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import values as V
from gleaner.functions import notes as N
from gleaner.functions import text as T
from gleaner.operators.joins import join_per_parent, mark_moved
from gleaner.operators.selection import set_columns, unmoved
from gleaner.operators.sequences import chapter_nav, index_lines


def classify_outcome(fetches: DataFrame, min_text: int = V.MIN_ARTICLE) -> DataFrame:
    """Add ``error struct<reason, detail, html>``, null for a fetch that gave usable content.

    ``fetches(url, status_code, exc, body, content)``: ``exc`` names what broke the
    request, ``content`` is the text that was extracted.
    """
    code, exc = F.col("status_code"), F.col("exc")
    length = F.coalesce(F.length("content"), F.lit(0))
    reason = (
        F.when(exc == "timeout", "timeout")
        .when(exc == "connection", "connection_error")
        .when(exc == "request", "request_error")
        .when(exc == "parse", "parse_error")
        .when(exc.isNotNull(), "unknown")
        .when(code >= 400, F.concat(F.lit("http_"), code.cast("string")))
        .when(F.col("body").isNull(), "fetch_failed")
        .when(length < min_text, "no_content")
    )
    detail = (
        F.when(exc == "timeout", F.concat(F.lit("Request timed out for "), "url"))
        .when(exc == "connection", F.concat(F.lit("Connection failed for "), "url"))
        .when(exc.isNotNull(), exc)
        .when(code >= 400, F.concat(code.cast("string"), F.lit(" for "), "url"))
        .when(F.col("body").isNull(), F.concat(F.lit("Failed to fetch "), "url"))
        .otherwise(F.concat(
            F.lit("Article extraction yielded "), length.cast("string"), F.lit(f" chars (min {min_text})")))
    )
    no_page = exc.isin("timeout", "connection")
    page = F.when(no_page | F.col("body").isNull(), "").otherwise(F.left("body", F.lit(V.ERROR_HTML_CHARS)))
    error = F.struct(reason.alias("reason"), detail.alias("detail"), page.alias("html"))
    return fetches.withColumn("error", F.when(reason.isNotNull(), error))


def apply_outcomes(ledger: DataFrame, outcomes: DataFrame, keys: list[str], run_ts: Column) -> DataFrame:
    """Ledger after a run: successes with their metrics and time, failures with their error.

    ``outcomes(keys, title, author, word_count, char_count, file_path, error)`` has one
    row per key; rows without an outcome stay as they are.
    """
    metrics = ["author", "word_count", "char_count", "file_path"]
    new = outcomes.select(
        *keys, F.lit(True).alias("_seen"), "error", *[F.col(c).alias(f"_{c}") for c in ["title", *metrics]])
    seen = F.coalesce(F.col("_seen"), F.lit(False))
    good, bad = seen & F.col("error").isNull(), seen & F.col("error").isNotNull()

    def old(name: str, kind: str) -> Column:
        return F.col(name) if name in ledger.columns else F.lit(None).cast(kind)

    kinds = {"author": "string", "word_count": "bigint", "char_count": "bigint", "file_path": "string"}
    return ledger.join(new, keys, "left").withColumns({
        "status": F.when(good, V.DOWNLOADED).when(bad, V.FAILED).otherwise(F.col("status")),
        "title": F.when(good, F.coalesce("_title", old("title", "string"))).otherwise(old("title", "string")),
        **{c: F.when(good, F.col(f"_{c}")).otherwise(old(c, kinds[c])) for c in metrics},
        "downloaded_at": F.when(good, run_ts).otherwise(old("downloaded_at", "timestamp")),
        **{f"error_{part}": F.when(bad, F.col(f"error.{part}")).otherwise(old(f"error_{part}", "string"))
           for part in ("reason", "detail", "html")},
    }).drop("_seen", "error", *[f"_{c}" for c in ["title", *metrics]])


def set_status(parents: DataFrame, where: Column, status: str) -> DataFrame:
    return set_columns(parents, where, ["status"], status=status)


def complete_parents(parents: DataFrame, checks: DataFrame, key: str, run_ts: Column) -> DataFrame:
    """Parents after a check ``(key, available, found_status)``.

    The check's time and status are always set; a completed parent gets its total, and
    keeps the time at which it was first seen complete.
    """
    joined = parents.join(checks.select(key, "available", "found_status"), key, "left")
    checked, done = F.col("found_status").isNotNull(), F.col("found_status") == "completed"
    return joined.withColumns({
        "status": F.coalesce("found_status", "status"),
        "last_checked_at": F.when(checked, run_ts).otherwise(F.col("last_checked_at")),
        "completed_at": F.when(done, F.coalesce("completed_at", run_ts)).otherwise(F.col("completed_at")),
        "total_chapters": F.when(done, F.col("available")).otherwise(F.col("total_chapters")),
    }).drop("available", "found_status")


def publish(
    ledger: DataFrame, notes: DataFrame, target: Column, moved_at: Column, keys: list[str]
) -> tuple[DataFrame, DataFrame]:
    """``(moves, ledger)``: rows to publish whose note exists, and the ledger with them marked.

    ``notes(path)`` lists what was written; ``target`` is each row's path in the vault.
    """
    written = notes.select(F.col("path").alias("file_path")).distinct()
    moves = unmoved(ledger).join(written, "file_path", "left_semi").select(
        *keys, "file_path", target.alias("target"))
    return moves, mark_moved(ledger, moves, keys, moved_at)


def rebuild_index_and_nav(
    chapters: DataFrame, changed: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(index lines, notes)`` of the novels in ``changed(novel_id)``, or of all.

    ``chapters(novel_id, name, num, content)``: the whole sequence of each changed novel
    is linked anew, so that chapters on both sides of a batch's border get their links.
    Older footers are replaced.
    """
    if changed is not None:
        chapters = join_per_parent(
            chapters, changed.select("novel_id").distinct(), ["novel_id"], ["num"], "left_semi")
    footers = chapter_nav(chapters).select("novel_id", "num", "footer")
    linked = chapters.join(footers, ["novel_id", "num"]).select(
        "novel_id", "num", N.with_nav("content", "footer").alias("content"))
    return index_lines(chapters), linked
