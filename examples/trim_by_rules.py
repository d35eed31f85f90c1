"""A tokenizer reduced to digits, ASCII letters and what it can't do without; no corpus."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from tokenloom import Config, TrimPipeline, render


def main(spark: SparkSession, model: str, out: str):
    config = Config(model=model, output_dir=out, selection={"keep_presets": ["digits", "ascii_letters"]})
    report = TrimPipeline(spark, config).run()
    print(render(report))
    return report


if __name__ == "__main__":
    main(SparkSession.builder.getOrCreate(), *sys.argv[1:])
