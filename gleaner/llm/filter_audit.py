"""Filter interaction audit: what each filter removes after every possible run of earlier ones.

Each filter's failing ids are stored as a table of their own. The ids of all documents pass these tables one after
the other: a left-semi join takes those that fail, a left-anti join those that do not. What results is every
document's class, the set of filters that it fails; documents are then counted by part and class, and the few
class rows stand for their documents. For each prefix of each order, a left-anti join against the classes that an
earlier filter takes leaves the survivors, a left-semi join of these the removals, and a left-semi join of the
others the redundant failures.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import staged

MIN_WORDS = 200
WORD = r"[^\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions that a text decides alone, by name."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    capitals = F.char_length(text) - F.char_length(F.translate(text, CAPITALS, ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.char_length(text),
        "D": F.regexp_like(text, F.lit("[#$%&*|]")),
    }


def failing_ids(docs: DataFrame) -> dict[str, DataFrame]:
    """The stored table of failing doc_ids of each filter, A to E, one row per id.

    A document fails E if its text is that of a smaller doc_id; 256 bits of SHA-2 stand for a text. An
    id that several rows repeat fails if one of its rows does; a null doc_id is an id too, but neither
    smaller nor larger than another. A null text counts as empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    alone = text_filters(F.col("text"))
    facts = staged(docs.select("doc_id", text.alias("text")).select(
        "doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), *[c.alias(name) for name, c in alone.items()]), "facts")
    out = {name: staged(facts.where(name).select("doc_id").distinct(), f"fails_{name}") for name in alone}
    first = facts.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    later = facts.where("doc_id is not null").select("doc_id", "sha").join(first, ["doc_id", "sha"], "left_anti")
    return out | {"E": staged(later.select("doc_id").distinct(), "fails_E")}


def _ids_in(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows whose doc_id is among the ids (``left_semi``) or not (``left_anti``); a null equals a null."""
    return rows.join(ids.withColumnRenamed("doc_id", "_failing"), F.col("doc_id").eqNullSafe(F.col("_failing")), how)


def classes(docs: DataFrame, labels: DataFrame, failing: dict[str, DataFrame], part: str) -> DataFrame:
    """(part, class, n, good, toxic): documents of each part that fail just the filters of the class."""
    of = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"),
                                      F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part")).join(of, "doc_id", "left")
    rows = rows.withColumn("class", F.lit(""))
    for name, ids in failing.items():
        taken = _ids_in(rows, ids, "left_semi").withColumn("class", F.concat("class", F.lit(name)))
        rows = staged(taken.union(_ids_in(rows, ids, "left_anti")), "classes")
    return staged(rows.groupBy("part", "class").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")), "counts")


def order_steps(names: str) -> list[tuple[str, int, str, str]]:
    """(filter_order, step, filter, before) of every order; ``before`` holds the earlier filters, sorted as in names."""
    return [("".join(order), i + 1, name, "".join(sorted(order[:i], key=names.index)))
            for order in permutations(names) for i, name in enumerate(order)]


def _letters(column: str) -> Column:
    return F.explode(F.filter(F.split(column, ""), lambda x: x != ""))


def audit(docs: DataFrame, labels: DataFrame, failing: dict[str, DataFrame], part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders of the filters, whose names are one letter each.

    ``failing`` holds each filter's doc_ids, in any table; ``part`` names the column that parts the documents,
    null meaning an empty string. Documents are rows: rows that repeat a doc_id count each and share their
    failures and labels. A label counts as good or toxic if one of its rows says 1; a null is no 1, and a label
    without doc_id labels nothing. A filter that takes nothing gets zeros. An empty table of documents gives an empty table.
    """
    counted, orders = classes(docs, labels, failing, part), order_steps("".join(failing))
    steps = sorted({(name, before) for _, _, name, before in orders})
    literal = F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(b).alias("before")) for f, b in steps])
    met = counted.select("*", F.inline(literal))
    # relations of classes: 2^filters of them at most
    kinds = counted.select("class").distinct()
    takes = F.broadcast(kinds.select("class", _letters("class").alias("filter")))
    gone = F.broadcast(kinds.select("class", F.inline(literal)).select("class", "filter", "before", _letters("before").alias("earlier"))
                       .join(takes.withColumnRenamed("filter", "earlier"), ["class", "earlier"], "left_semi")
                       .select("class", "filter", "before").distinct())
    prefix = ["class", "filter", "before"]
    left = met.join(gone, prefix, "left_anti")
    removed = left.join(takes, ["class", "filter"], "left_semi")
    redundant = met.join(gone, prefix, "left_semi").join(takes, ["class", "filter"], "left_semi")

    def tally(rows: DataFrame, **values: str) -> DataFrame:
        names = ["survivors", "removed", "redundant", "good_lost", "toxic_lost"]
        return rows.select("part", "filter", "before", *[F.expr(values.get(c, "0L")).alias(c) for c in names])

    sums = tally(left, survivors="n").union(tally(removed, removed="n", good_lost="good", toxic_lost="toxic")).union(
        tally(redundant, redundant="n")).union(tally(met)).groupBy("part", "filter", "before").agg(
        *[F.sum(c).alias(c) for c in ["survivors", "removed", "redundant", "good_lost", "toxic_lost"]])
    unique = counted.where(F.length("class") == 1).select("part", F.col("class").alias("filter"), F.col("n").alias("unique_fails"))
    places = docs.sparkSession.createDataFrame(orders, "filter_order string, step int, filter string, before string")
    rows = sums.join(F.broadcast(places), ["filter", "before"]).join(unique, ["part", "filter"], "left")
    return rows.select(
        "part", "filter_order", "step", (F.col("survivors") - F.col("removed")).alias("kept"), "removed", "redundant",
        F.coalesce("unique_fails", F.lit(0)).alias("unique_fails"), "good_lost", "toxic_lost",
        F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Five filters over all documents, by language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), failing_ids(docs))


OP11_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
facts AS (SELECT doc_id, part,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS class FROM words),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
    max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
classes AS (SELECT part, class, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
    FROM facts LEFT JOIN marks USING (doc_id) GROUP BY part, class),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
met AS (SELECT *, translate(class, before, '') <> class AS gone, contains(class, f) AS fails FROM classes, steps),
sums AS (SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND fails), 0) AS redundant, coalesce(sum(n) FILTER (class = f), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS toxic_lost
    FROM met GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM sums
"""
