"""Corpus pipeline: quality rules, exact dedup, near-dedup, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm import bpe, exact_dedup, mixing, near_dedup, quality
from tokenloom.sources.scratch import clear, cut, made


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rules or the line labels reject."""
    return quality.keep(docs, quality.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the one with the largest doc_id."""
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates."""
    return near_dedup.representatives(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources meet their target weights."""
    return mixing.mixture(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every row and decode it again: doc_id, n_tokens and digests of ids and decoded bytes."""
    return bpe.digests(docs, *bpe.public_vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("source mix", source_mix),
    ("byte-level BPE", encoded),
]

#: A conditional random field, alignments and Newton iterations aren't expressible here; tests/llm compares brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's scratch tables and its input are deleted once its output is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = made()
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        clear(spark, since)
    return STAGES[-1][1](spark, docs, sf_dir)
