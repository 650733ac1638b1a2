"""Spans of regular expressions as Columns, and their text form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import let

SPAN = "struct<start:int,rank:int,kind:string,end:int>"


#: Items that one fold walks before their results are joined on.
CHUNK = 256


def fold(items: Column, empty: Column, step: Callable[[Column, Column], Column], into: str) -> Column:
    """The array ``into`` of a fold whose state is (at, into), with ``at`` from 0; ``empty`` is the array at the start.

    An array that grows is copied at each step, so it grows within short runs, and once a run.
    """
    runs = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(items) - 1, F.lit(CHUNK)).cast("int")),
                       lambda i: F.slice(items, i * CHUNK + 1, F.lit(CHUNK)))

    def walk(state: Column, run: Column) -> Column:
        start = F.struct(state["at"].alias("at"), empty.alias(into))
        return let(F.aggregate(run, start, step), lambda r: F.struct(r["at"].alias("at"), F.concat(state[into], r[into]).alias(into)))

    return F.aggregate(runs, F.struct(F.lit(0).alias("at"), empty.alias(into)), walk, lambda s: s[into])


def match_spans(text: Column, pattern: str, kind: str, rank: int, least: int = 1, group: int = 0) -> Column:
    """Array of SPAN: leftmost non-overlapping matches of a pattern, in code points.

    Matches whose ``group`` is shorter than ``least`` are dropped after matching. The pattern must
    not match the empty text: the pieces between matches then give every start.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    own = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), own.alias("own"))

    def step(state: Column, z: Column) -> Column:
        start = state["at"] + F.length(z["gap"])
        end = start + F.coalesce(F.length(z["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        keep = F.coalesce(F.length(z["own"]) >= least, F.lit(False))
        return F.struct(end.alias("at"), F.when(keep, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    none = F.array().cast(f"array<{SPAN}>")
    spans = let(zipped, lambda items: fold(items, none, step, "spans"))
    return F.when(F.size(found) > 0, spans).otherwise(none)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
