"""Two tokenizer documents compared."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from tokenloom import TokenizerDocument, compare_tokenizers
from tokenloom.operators.compare import render


def main(spark: SparkSession, base: str, other: str):
    report = compare_tokenizers(spark, TokenizerDocument.from_path(base), TokenizerDocument.from_path(other), ["the cat sat", "a dog"])
    print(render(report))
    return report


if __name__ == "__main__":
    main(SparkSession.builder.getOrCreate(), *sys.argv[1:])
