"""A tokenizer and its Parquet tables reduced to what covers 99% of a corpus."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from tokenloom import Config, TrimPipeline, render


def main(spark: SparkSession, model: str, corpus: str, out: str):
    datasets = [{"path": "parquet", "data_files": corpus}]
    config = Config(model=model, output_dir=out, corpus={"datasets": datasets}, selection={"coverage": 0.99, "keep_presets": ["digits"]})
    report = TrimPipeline(spark, config).run()
    print(render(report))
    return report


if __name__ == "__main__":
    main(SparkSession.builder.getOrCreate(), *sys.argv[1:])
