"""Sharding by rendezvous hashing: each record goes to the shard that scores best for its key.

The score of a shard is -ln(u) / weight with u in (0, 1] from the md5 of key and shard, and the
least wins; shares follow the weights. A further shard changes no other score, so it takes records
only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import apart, ordinal_within


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Index of the shard of a key; weights by shard, each above 0. A null key counts as empty."""
    text = F.coalesce(key.cast("string"), F.lit(""))

    def score(shard: int, weight: float) -> Column:
        digits = F.conv(F.substring(F.md5(F.concat(text, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double")
        return F.struct((-F.log((digits + 1) / float(2**52)) / weight).alias("score"), F.lit(shard).alias("shard"))

    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    return F.array_min(F.array(*[score(i, w) for i, w in enumerate(weights)]))["shard"]


def shard(docs: DataFrame, weights: list[float], key: str = "doc_id") -> DataFrame:
    """All rows with size, text_crc32, shard, slot and grown_shard (the shard if one more of weight 1 came).

    ``size`` is the UTF-8 length of the text plus 1; a null text has none. Slots run from 0 without
    gaps within each shard, in the order of a hash of the key; rows that repeat a key share its shard.
    An empty table gives an empty table. Other columns stay as they are, but for those named like the new ones.
    """
    new = ["size", "text_crc32", "shard", "grown_shard", "slot"]
    return apart(docs, [key, "text"], new, lambda rows: _sharded(rows, weights, key))


def _sharded(docs: DataFrame, weights: list[float], key: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumns({
        "size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary")),
        "shard": rendezvous(F.col(key), weights), "grown_shard": rendezvous(F.col(key), [*weights, 1.0])})
    return ordinal_within(rows, "shard", key, ["size", "text_crc32"], "slot")


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents over 16 shards of equal weight, by doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs, [1.0] * 16).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
