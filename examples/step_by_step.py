"""The same trim without a pipeline: count, cut, close over merges, renumber."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from pyspark.sql import functions as F

from tokenloom import TokenizerDocument, count_tokens, cut_by_corpus, dense_remap, expand_dependencies, get_backend, texts


def main(spark: SparkSession, document: str, corpus: str):
    doc = TokenizerDocument.from_path(document)
    tables = doc.tables(spark)
    docs = texts(spark.read.parquet(corpus))
    counts = count_tokens(docs, doc.to_json()).groupBy("token_id").agg(F.sum("n").alias("n"))
    kept = cut_by_corpus(counts, top_k=500).select("token_id").union(tables["structural"].select("token_id")).distinct()
    needed = get_backend(doc.model_type).dependencies(tables)
    if needed is not None:
        kept = kept.union(expand_dependencies(kept, needed))
    numbers = dense_remap(kept)
    numbers.show(5)
    return numbers


if __name__ == "__main__":
    main(SparkSession.builder.getOrCreate(), *sys.argv[1:])
