"""Secret scans over a trigram inverted index.

From each rule's pattern a Boolean query over trigrams follows: a conjunction of clauses, each clause
a choice between sets of trigrams that must all occur. The index maps every trigram that some query
names to the documents holding it; a document whose postings satisfy a rule's query is a candidate,
and only candidates meet the rule's pattern. A rule without mandatory trigrams scans every document.
Index and queries are in lower case, so that they hold for patterns in either case.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.spans import SPAN, match_spans, spans_text


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern and the least length of a group, else the match is dropped."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


#: Base kinds first, in the order of the listing; fixed values.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),  # a shorter run holds no longer one, so this equals dropping
    Rule("hex", r"[0-9a-f]{24,}"),
)
OWN_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 24),
)
RULES = BASE_RULES + OWN_RULES
_MOST = 16  # alternatives a clause may have before it is given up


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i: i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> list[frozenset[frozenset[str]]]:
    """Clauses that every match satisfies: in each, all trigrams of at least one alternative occur.

    Adjacent pieces with few possible texts are multiplied out; anything open-ended or optional
    between them cuts. A pattern that yields no clause has no mandatory trigrams.
    """
    clauses: list[frozenset[frozenset[str]]] = []

    def close(texts: list[str]) -> None:
        found = [trigrams(t) for t in texts]
        if found and all(found):
            clauses.append(frozenset(found))

    def walk(items, texts: list[str]) -> list[str]:
        for op, arg in items:
            some = possible(op, arg)
            if some is None or len(some) * len(texts) > _MOST:
                close(texts)
                texts = some or [""]
                if some is None and str(op) == "MAX_REPEAT" and arg[0] > 0:
                    walk(arg[2], [""])
            else:
                texts = [a + b for a, b in product(texts, some)]
        return texts

    def possible(op, arg) -> list[str] | None:
        """All texts of an element in lower case, or None if they are too many to list."""
        name = str(op)
        if name == "LITERAL":
            return [chr(arg).lower()]
        if name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= _MOST:
            return sorted({chr(c).lower() for _, c in arg})
        if name == "SUBPATTERN":
            return listed(arg[-1])
        if name == "BRANCH":
            sides = [listed(side) for side in arg[1]]
            return None if None in sides else sorted({t for side in sides for t in side})
        if name == "MAX_REPEAT" and arg[1] == 1:
            inner = listed(arg[2])
            return None if inner is None else sorted({*inner, *([""] if arg[0] == 0 else [])})
        return None

    def listed(items) -> list[str] | None:
        texts = [""]
        for op, arg in items:
            some = possible(op, arg)
            if some is None or len(some) * len(texts) > _MOST:
                return None
            texts = [a + b for a, b in product(texts, some)]
        return texts

    close(walk(re._parser.parse(pattern), [""]))
    return clauses


def query_table(spark, rules: tuple[Rule, ...]) -> DataFrame:
    """(rule, clause, alternative, needed, trigram) of all rules; code bounds it."""
    rows = [(r.kind, c, a, len(grams), g)
            for r in rules for c, clause in enumerate(trigram_query(r.pattern))
            for a, grams in enumerate(sorted(map(sorted, clause))) for g in grams]
    return spark.createDataFrame(rows, "rule string, clause int, alternative int, needed int, trigram string")


def trigram_index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Postings (trigram, doc) of the given trigrams over all documents, a row a posting."""
    low = F.lower("text")
    held = F.filter(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]), lambda g: g.isNotNull())
    return docs.select("doc", low.alias("low")).select("doc", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(doc, rules): the rules whose query the postings of a document satisfy."""
    met = index.join(F.broadcast(queries), "trigram").groupBy("doc", "rule", "clause", "alternative").agg(
        F.count_distinct("trigram").alias("n"), F.first("needed").alias("needed")).where("n = needed")
    wanted = queries.groupBy("rule").agg(F.count_distinct("clause").alias("clauses"))
    full = met.groupBy("doc", "rule").agg(F.count_distinct("clause").alias("n")).join(F.broadcast(wanted), "rule").where("n = clauses")
    return full.groupBy("doc").agg(F.collect_set("rule").alias("rules"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) of every row: SPAN structs of all rules, sorted by start, then rule order.

    A null text counts as empty. Rows that repeat a doc_id are scanned one by one; their postings
    meet, which can only add candidates. Rows without a doc_id have no postings and meet every
    pattern. An empty table gives an empty table.
    """
    rows = docs.select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    queries = query_table(docs.sparkSession, rules)
    grams = sorted({g for r in rules for clause in trigram_query(r.pattern) for grams in clause for g in grams})
    found = candidates(trigram_index(rows, grams), queries)
    indexed = {r.kind for r in rules if trigram_query(r.pattern)}
    held = rows.join(found, "doc", "left")
    none = F.array().cast(f"array<{SPAN}>")
    parts = []
    for rank, rule in enumerate(rules):
        spans = match_spans(F.col("text"), rule.pattern, rule.kind, rank, rule.least, rule.group)
        meets = F.col("doc").isNull() | F.coalesce(F.array_contains("rules", rule.kind), F.lit(False))
        parts.append(F.when(meets, spans).otherwise(none) if rule.kind in indexed else spans)
    return held.select(F.col("doc").alias("doc_id"), F.array_sort(F.concat(*parts)).alias("spans"))


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of all documents by all rules."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    count = [number(r.kind) for r in BASE_RULES]
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    return found.select("doc_id", *count, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def _sql_spans(rule: Rule, rank: int) -> str:
    """DuckDB list of spans of one rule."""
    p = rule.pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{p}')) + 1), lambda i: {{
      's': (list_sum(list_transform(regexp_split_to_array(t, '{p}')[1:i], lambda g: length(g)))
         + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}')[1:i - 1], lambda g: length(g))), 0))::BIGINT, 'r': {rank}, 'k': '{rule.kind}',
      'n': length(regexp_extract_all(t, '{p}')[i]),
      'own': length(regexp_extract_all(t, '{p}', {rule.group})[i])}}), lambda x: x.own >= {rule.least})"""


def _sql() -> str:
    text = "array_to_string(list_transform(list_sort({}), lambda x: concat(x.k, ':', x.s, ':', x.s + x.n)), ',')"
    base = "list_concat(" + ", ".join(f"s{i}" for i in range(len(BASE_RULES))) + ")"
    every = "list_concat(" + ", ".join(f"s{i}" for i in range(len(RULES))) + ")"
    return f"""
WITH spans AS (SELECT doc_id, {', '.join(f'{_sql_spans(r, i)} AS s{i}' for i, r in enumerate(RULES))}
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
SELECT doc_id, {', '.join(f'len(s{i})::BIGINT AS n_{r.kind}' for i, r in enumerate(BASE_RULES))},
       sha256({text.format(base)}) AS base_sha256, {text.format(every)} AS spans FROM spans"""


OP7_SQL = _sql()
