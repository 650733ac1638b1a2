"""License scans as an exact set-similarity join of text blocks with license templates.

A block is a window of ``ceil(WINDOW * |T|)`` words of the whole text, across line breaks, for a template of |T| words.
Words are ordered by how often they occur in the whole corpus, rarest first. A window that holds at
least ``ceil(threshold * |T|)`` distinct words of a template must hold one of the template's
``|T| - needed + 1`` rarest words (prefix filter). Only the windows around such a word are looked at, and only if all
of them together hold ``needed`` words (length filter). What passes is counted exactly.
"""

from __future__ import annotations

import math
import re
import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import let
from gleaner.llm.spans import fold
#: Characters between words, before letters are lowered; fixed values.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases that name a license wherever they stand; fixed values.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Opening statements of common licenses; the label of each.
TEMPLATES = (
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)
#: Share of a template's words that a block must hold.
THRESHOLD = 0.8
#: Words of a window for each word of the template.
WINDOW = 1.25


def words_of(text: str) -> list[str]:
    """Words of a template; the rule of ``GAP`` for plain Python."""
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.split(GAP, text) if w]


def spaced(text: Column) -> Column:
    """The words of a text, each after a space, and a last space; letters as they are."""
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.concat(text, F.lit(" ")), GAP, " ")))


def lowered(text: Column) -> Column:
    """A to Z in small letters; other letters stay, whatever their case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_ranks(docs: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """Rank of each template word by its count over all documents, rarest first, ties by word.

    Counts are summed in the map tasks; the vocabulary of the templates bounds the result.
    """
    words = F.split(lowered(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), GAP, " "))), " ")
    seen = docs.select(F.explode(F.filter(words, lambda w: w.isin(sorted(vocabulary)))).alias("w")).groupBy("w").agg(
        F.count(F.lit(1)).alias("n")).collect()
    counts = {r.w: r.n for r in seen}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def needed(template: list[str], threshold: float) -> int:
    """Words that a block must share with a template."""
    return math.ceil(threshold * len(set(template)) - 1e-9)


def windows_around(words: Column, at: Column, label: str, template: list[str], ranks: dict[str, int], threshold: float) -> Column:
    """(start, label, score) of the window with word number ``at`` that holds most of a template, the last of equals.

    Null where no window around it meets the threshold, or where the word is none of the template's rarest.
    """
    ordered = sorted(set(template), key=ranks.__getitem__)
    size, least, reach = len(ordered), needed(template, threshold), math.ceil(WINDOW * len(template))
    own = F.array(*map(F.lit, ordered))
    low = F.greatest(at - reach + 1, F.lit(0))
    starts = F.filter(F.sequence(low, at), lambda j: F.get(words, j).isin(ordered))
    held = F.transform(starts, lambda j: F.struct(
        F.size(F.array_intersect(F.slice(words, j + 1, reach), own)).alias("shared"), j.alias("start")))
    best = F.transform(F.array(F.array_max(held)), lambda b: F.when(b["shared"] >= least, F.struct(
        b["start"].alias("start"), F.lit(label).alias("label"), (b["shared"] / F.lit(float(size))).alias("score"))))
    near = F.size(F.array_intersect(F.slice(words, low + 1, 2 * reach - 1), own))
    return F.when(F.get(words, at).isin(ordered[: size - least + 1]) & (near >= least), F.get(best, F.lit(0)))


def text_blocks(text: Column, ranks: dict[str, int], threshold: float, templates) -> Column:
    """Array of (start, label, score): the windows of a text, by their first word's number, that meet a template.

    Texts without a prefix word of any template are passed over by one pattern.
    """
    listed = [(label, words_of(t)) for label, t in templates]
    rare = sorted({w for _, t in listed for w in sorted(set(t), key=ranks.__getitem__)[: len(set(t)) - needed(t, threshold) + 1]})
    hint = F.lit(f"(?i)(?:^|{GAP[:-1]})(?:{'|'.join(rare)})(?:{GAP[:-1]}|$)")
    split = F.split(lowered(F.trim(F.regexp_replace(text, GAP, " "))), " ")

    def met(words: Column) -> Column:
        hits = F.filter(F.transform(words, lambda w, i: F.when(w.isin(rare), i)), lambda i: i.isNotNull())
        around = F.transform(hits, lambda i: F.array(*[windows_around(words, i, label, t, ranks, threshold) for label, t in listed]))
        return F.array_distinct(F.filter(F.flatten(around), lambda m: m.isNotNull()))

    none = F.array().cast("array<struct<start:int,label:string,score:double>>")
    return F.when(F.rlike(text, hint), F.get(F.transform(F.array(split), met), F.lit(0))).otherwise(none)


def line_of(text: Column, word: Column) -> Column:
    """Number of the line, from 0, that holds a word of the text, by the word's number."""
    sizes = F.transform(F.split(text, "\n"), lambda line: F.size(
        F.filter(F.split(F.regexp_replace(line, GAP, " "), " "), lambda w: w != "")))
    return F.aggregate(sizes, F.struct(word.cast("int").alias("left"), F.lit(0).alias("line")), lambda s, n: F.struct(
        (s["left"] - n).alias("left"), (s["line"] + (s["left"] >= n).cast("int")).alias("line")), lambda s: s["line"])


def scan_blocks(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """(doc_id, block, label, score): every place of every text that holds enough of a template; ``block`` is the
    number of the line in which the window starts."""
    ranks = word_ranks(docs, {w for _, t in templates for w in words_of(t)})
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = rows.select("doc_id", "text", F.inline(text_blocks(F.col("text"), ranks, threshold, templates)))
    return found.select("doc_id", line_of(F.col("text"), F.col("start")).alias("block"), "label", "score")


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    ``score`` is the largest share of a template's words in a window, 1.0 where a phrase stands, 0.0
    where nothing meets. A null or empty text has no words and nulls for both places. Rows are scanned
    one by one, so repeated rows repeat. An empty table gives an empty table.
    """
    vocabulary = {w for _, t in templates for w in words_of(t)}
    ranks = word_ranks(docs, vocabulary)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), spaced(text).alias("words"))
    n_words = F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) - 1

    def places(phrase: str) -> Column:
        """Word numbers of a phrase: the pieces between its places, counted in spaces."""
        pieces = F.split("words", f"(?i)(?<= ){phrase}(?= )", -1)
        skip = phrase.count(" ")
        heads = F.slice(pieces, 1, F.size(pieces) - 1)
        count = F.transform(heads, lambda p: F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit(""))))
        none = F.array().cast("array<bigint>")

        def step(state: Column, n: Column) -> Column:
            here = F.array((state["at"] + n - 1).cast("long"))
            return F.struct((state["at"] + n + skip).alias("at"), F.concat(state["all"], here).alias("all"))

        found = let(count, lambda counts: fold(counts, none, step, "all"))
        return F.when(F.rlike("words", F.lit(f"(?i) {phrase} ")), found).otherwise(none)

    found = {p: places(p) for p in PHRASES}

    def named(phrase: str, label: str) -> Column:
        return F.transform(found[phrase], lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    base = F.flatten(F.array(*[named(p, label) for p, label in PHRASES.items()]))
    held = rows.select("doc_id", n_words.alias("n_words"), base.alias("base"), text_blocks(F.col("text"), ranks, threshold, templates).alias("blocks"))

    def names(*labels: Column) -> Column:
        return F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(*labels))))

    own = F.col("base.label")
    return held.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("base").cast("long").alias("n_base"),
        F.array_min("base.at").alias("first_word"), F.array_max("base.at").alias("last_word"),
        names(own).alias("base_labels"), names(own, F.col("blocks.label")).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("blocks.score"), F.lit(0.0))).alias("score"))


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    """License phrases and templates in all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    lists = [(label, sorted(set(words_of(t)))) for label, t in TEMPLATES]
    values = ", ".join(f"('{label}', {words!r}, {needed(words, THRESHOLD)})" for label, words in lists)
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES.items())
    words = f"list_filter(regexp_split_to_array({{}}, '{GAP}'), lambda x: x <> '')"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
templates(label, tw, least) AS (VALUES {values}), phrases(pw, label) AS (VALUES {phrases}),
split AS (SELECT doc_id, list_transform({words.format('t')}, lambda x: lower(x)) AS w FROM docs),
base AS (
  SELECT doc_id, p.label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(pw)] = pw)) AS place
  FROM split, phrases p),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs),
blocks AS (SELECT doc_id, list_distinct(list_transform({words.format('line')}, lambda x: lower(x))) AS w FROM lines),
own AS (
  SELECT doc_id, label, len(list_intersect(w, tw)) / len(tw)::DOUBLE AS score FROM blocks, templates
  WHERE len(list_intersect(w, tw)) >= least),
based AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, list(DISTINCT label) AS labels FROM base GROUP BY 1),
owned AS (SELECT doc_id, max(score) AS score, list(DISTINCT label) AS labels FROM own GROUP BY 1)
SELECT s.doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, lo AS first_word, hi AS last_word,
       array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(o.labels, [])))), ',') AS labels,
       CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(o.score, 0.0::DOUBLE) END AS score
FROM split s LEFT JOIN based b USING (doc_id) LEFT JOIN owned o USING (doc_id)"""


OP10_SQL = _sql()
