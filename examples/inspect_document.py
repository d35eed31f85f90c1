"""What a tokenizer document holds: its figures, and how many tokens each rule names."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from tokenloom import TokenizerDocument, available_presets, resolve_preset


def main(spark: SparkSession, document: str):
    doc = TokenizerDocument.from_path(document)
    tables = doc.tables(spark)
    sizes = {name: resolve_preset(name, doc, tables).count() for name in available_presets() if ":" not in name}
    for name, value in (doc.describe() | sizes).items():
        print(f"{name:24}{value}")
    return sizes


if __name__ == "__main__":
    main(SparkSession.builder.getOrCreate(), *sys.argv[1:])
