"""Counts of a local folder's texts, kept for later runs."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from tokenloom import Corpus, TokenizerDocument, count_corpus


def main(spark: SparkSession, document: str, folder: str, cache: str):
    doc = TokenizerDocument.from_path(document)
    counts = count_corpus(spark, doc.to_json(), Corpus(datasets=[{"path": folder, "split": "train[:50%]"}], counts_cache=cache))
    print(f"{counts.total:,} tokens, {counts.distinct():,} distinct, in {counts.documents:,} documents")
    return counts


if __name__ == "__main__":
    main(SparkSession.builder.getOrCreate(), *sys.argv[1:])
