"""Token counts over one corpus or several, their cache, and what is read off them."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.encode import count_tokens
from tokenloom.sources.corpus import open_dataset, path_exists, sample, texts
from tokenloom.sources.scratch import cut


def count_occurrences(tokens: DataFrame, key: str = "token") -> DataFrame:
    """key and n: how often each token occurs."""
    return tokens.groupBy(key).agg(F.count("*").alias("n"))


def count_weighted(tokens: DataFrame, docs: list[str], weight, key: str = "token") -> DataFrame:
    """key and n: counts by document times its weight, rounded half to even, summed. Zero sums stay.

    Where the weight is a whole number there is nothing to round, so documents of that weight are counted together, before anything
    is shuffled."""
    weight = F.col(weight) if isinstance(weight, str) else weight
    whole = F.coalesce(weight == F.floor(weight), F.lit(False))
    alike = [F.when(whole, weight).alias("_weight"), *[F.when(~whole, F.col(c)).alias(f"_doc{i}") for i, c in enumerate(docs)]]
    each = tokens.groupBy(*alike, key).agg((F.count("*") * F.first(weight)).alias("w"))
    return each.groupBy(key).agg(F.sum(F.bround("w", 0).cast("long")).alias("n"))


def coverage_of(counts: DataFrame, kept: DataFrame, total: int | None = None, key: str = "token_id") -> DataFrame:
    """One row, coverage: the share of all occurrences that fall on kept tokens; 1.0 of an empty corpus."""
    marked = counts.join(kept.select(key).distinct().withColumn("_in", F.lit(True)), key, "left")
    whole = F.lit(total).cast("double") if total is not None else F.coalesce(F.sum("n"), F.lit(0)).cast("double")
    part = F.coalesce(F.sum(F.when(F.col("_in"), F.col("n"))), F.lit(0))
    return marked.agg(F.when(whole == 0, F.lit(1.0)).otherwise(part / whole).alias("coverage"))


@dataclass
class Counts:
    """Counts by token id, with the totals they were stored with, and sample texts."""

    counts: DataFrame
    total: int
    documents: int
    samples: list[str]

    def distinct(self) -> int:
        return self.counts.count()

    def coverage_of(self, ids: Iterable[int]) -> float:
        spark = self.counts.sparkSession
        kept = spark.createDataFrame([(int(i),) for i in set(ids)], "token_id int")
        return coverage_of(self.counts, kept, self.total).first()[0]

    def ranked_ids(self) -> DataFrame:
        """token_id, n in order of falling count, then id."""
        return self.counts.orderBy(F.desc("n"), "token_id")

    def to_dict(self) -> dict:
        """For interchange; as many entries as the vocabulary has tokens."""
        rows = self.counts.orderBy("token_id").collect()
        return {"counts": {str(r["token_id"]): r["n"] for r in rows}, "total_num_tokens": self.total, "num_documents": self.documents, "samples": self.samples}

    def save(self, path: str | Path) -> None:
        """A ``.json`` path gets one document, for interchange; any other a folder of two tables on any file system."""
        if Path(path).suffix != ".json":
            spark = self.counts.sparkSession
            self.counts.write.mode("overwrite").parquet(f"{path}/counts")
            about = spark.createDataFrame([(self.total, self.documents, self.samples)], "total long, documents long, samples array<string>")
            about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
            return
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(self.to_dict(), ensure_ascii=False), "utf-8")

    @classmethod
    def from_dict(cls, spark: SparkSession, data: dict) -> Counts:
        rows = [(int(i), int(n)) for i, n in data["counts"].items()]
        return cls(spark.createDataFrame(rows, "token_id int, n long"), int(data["total_num_tokens"]), int(data["num_documents"]), list(data.get("samples", [])))

    @classmethod
    def load(cls, spark: SparkSession, path: str | Path) -> Counts:
        if Path(path).suffix != ".json":
            about = spark.read.parquet(f"{path}/about").first()
            return cls(spark.read.parquet(f"{path}/counts"), about["total"], about["documents"], list(about["samples"]))
        return cls.from_dict(spark, json.loads(Path(path).read_text("utf-8")))


def count_corpus(spark: SparkSession, document: str, corpus, seed: int = 0, sample_size: int = 256) -> Counts:
    """Count all datasets of a configuration, each with its weight; the cache is read if there, else written."""
    if corpus.counts_cache and path_exists(spark, corpus.counts_cache):
        return Counts.load(spark, corpus.counts_cache)
    parts, read = [], None
    for spec in corpus.datasets:
        docs = texts(open_dataset(spark, spec), spec.text_column, spec.max_samples, source=spec.path).select("text")
        parts.append(count_tokens(docs, document, spec.weight))
        read = docs if read is None else read.unionByName(docs)
    if read is None:
        raise ValueError("no datasets to count")
    together = parts[0]
    for more in parts[1:]:
        together = together.unionByName(more)
    counts = together.groupBy("token_id").agg(F.sum("n").alias("n"))
    counts = cut(counts, "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    out = Counts(counts, total, read.count(), [r["text"] for r in sample(read, sample_size, seed).collect()])
    if corpus.counts_cache:
        out.save(corpus.counts_cache)
    return out
