"""Command line: trim, count, inspect, compare, presets."""

from __future__ import annotations

import argparse
import json
import sys

from tokenloom.logs import show_messages
from tokenloom.operators import compare as C
from tokenloom.operators.presets import render_presets
from tokenloom.plans.config import load_config, parse_overrides
from tokenloom.plans.run import TrimPipeline, render
from tokenloom.sources.corpus import read_sample_texts
from tokenloom.sources.backends import supported_model_types
from tokenloom.sources.tokenizer import TokenizerDocument


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tokenloom").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tokenloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    trim = commands.add_parser("trim", help="trim a tokenizer and its tables")
    trim.add_argument("config", help="a settings file or a tokenizer")
    trim.add_argument("overrides", nargs="*", help="key=value")
    trim.add_argument("-o", "--output-dir")
    trim.add_argument("--overwrite", action="store_true", default=None)
    trim.add_argument("--max-vocab-size", type=int)
    trim.add_argument("--dry-run", action="store_true")
    count = commands.add_parser("count", help="count a corpus")
    count.add_argument("config")
    count.add_argument("overrides", nargs="*")
    count.add_argument("-o", "--output", required=True)
    inspect = commands.add_parser("inspect", help="describe a tokenizer")
    inspect.add_argument("tokenizer")
    compare = commands.add_parser("compare", help="compare two tokenizers")
    compare.add_argument("base")
    compare.add_argument("other")
    compare.add_argument("--texts", help="a file with a text a line")
    compare.add_argument("--preset", action="append", default=[])
    compare.add_argument("--examples", type=int, default=10)
    compare.add_argument("-o", "--output")
    commands.add_parser("presets", help="list the presets")
    parser.add_argument("-v", "--verbose", action="store_true", help="show all messages")
    args = parser.parse_args(argv)
    show_messages("DEBUG" if args.verbose else "INFO")
    if args.command == "presets":
        print(render_presets())
    elif args.command == "inspect":
        about = TokenizerDocument.from_path(args.tokenizer).describe()
        print(json.dumps(about | {"supported": about["model_type"] in supported_model_types()}, indent=2, ensure_ascii=False))
    elif args.command == "compare":
        base, other = TokenizerDocument.from_path(args.base), TokenizerDocument.from_path(args.other)
        report = C.compare_tokenizers(_spark(), base, other, read_sample_texts(args.texts) if args.texts else None, args.preset, args.examples)
        print(C.render(report))
        if args.output:
            C.save(report, args.output)
    else:
        flags = {"output_dir": args.output_dir, "overwrite": args.overwrite, "selection.max_vocab_size": args.max_vocab_size} if args.command == "trim" else {}
        config = load_config(args.config, flags | parse_overrides(args.overrides))
        run = TrimPipeline(_spark(), config)
        if args.command == "trim":
            print(render(run.run(dry_run=args.dry_run)))
        else:
            if not config.corpus.datasets:
                parser.error("no datasets to count")
            run.count().save(args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
