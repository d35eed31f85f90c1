"""A rule of one's own: tokens that begin a word."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from pyspark.sql import functions as F

from tokenloom import TokenizerDocument, available_presets, register_preset, resolve_preset


def main(spark: SparkSession, document: str):
    if "word_starts" not in available_presets():

        @register_preset("word_starts")
        def word_starts(document, tables):
            """Tokens whose text begins with a blank."""
            return tables["vocab"].where(F.col("surface").startswith(" ")).select("token")

    doc = TokenizerDocument.from_path(document)
    found = resolve_preset("word_starts", doc, doc.tables(spark))
    found.show(10)
    return found


if __name__ == "__main__":
    main(SparkSession.builder.getOrCreate(), *sys.argv[1:])
