"""A training corpus from raw documents: each stage writes its documents for the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm.common import documents, staged
from gleaner.llm.exact_dedup import drop_exact_copies
from gleaner.llm.mixing import mix, write_order
from gleaner.llm.ngram_jaccard import jaccard_components
from gleaner.llm.packing import pack_documents
from gleaner.llm.quality import fit, judge


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the ratio of trusted to raw n-grams."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, model).where("kept").select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per text: the smallest doc_id stays."""
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word sets, similarity 0.8; the smallest doc_id stays."""
    gone = jaccard_components(docs, 5, 80, 100).where("component_id <> doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in mixed order: sources weigh the square root of their rows."""
    return write_order(mix(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; equal lengths follow the order of the mixture's files."""
    return pack_documents(docs, in_file_order=True)


STAGES = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("packing", packing),
]

#: A fitted model and a tokenizer are no SQL: tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
