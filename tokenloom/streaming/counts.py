"""Incremental token counts over a stream of texts. An extra: the batch counts are the engine's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tokenloom.functions.text import words


def token_stream(docs: DataFrame, text: str = "text") -> DataFrame:
    """token and n of a streaming table so far; Spark's state store holds one row a token."""
    found = docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.explode(words(F.col(text))).alias("token"))
    return found.groupBy("token").agg(F.count("*").alias("n"))


def write_counts(docs: DataFrame, folder: str, checkpoint: str, text: str = "text") -> StreamingQuery:
    """Keep the changed counts of each micro-batch as Parquet under ``folder/batch=N``; a batch that runs again replaces its own
    folder, so that the newest row of a token is its count."""
    counts = token_stream(docs, text)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()


def latest(rows: DataFrame) -> DataFrame:
    """token and n from what ``write_counts`` has kept."""
    return rows.groupBy("token").agg(F.max_by("n", "batch").alias("n"))
