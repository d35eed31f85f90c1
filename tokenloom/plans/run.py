"""A whole run: read, count, select, renumber, verify, write, report."""

from __future__ import annotations

import fnmatch
import json
import logging
import shutil
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from tokenloom.operators import remap as R
from tokenloom.operators.counting import Counts, count_corpus
from tokenloom.operators.selection import Selection, select_tokens
from tokenloom.operators.verify import verify_tokenizer
from tokenloom.plans.config import Config
from tokenloom.sources.tokenizer import TokenizerDocument

log = logging.getLogger(__name__)
REPORT, SETTINGS = "trim_report.json", "resolved_config.yaml"


def guard(folder: str | Path, overwrite: bool) -> Path:
    """The output folder, made if need be; one with anything in it only on request."""
    path = Path(folder)
    if path.exists() and not path.is_dir():
        raise NotADirectoryError(f"{folder} is not a folder")
    if path.is_dir() and any(path.iterdir()) and not overwrite:
        raise FileExistsError(f"{folder} is not empty; set overwrite to write into it")
    path.mkdir(parents=True, exist_ok=True)
    return path


def copy_sidecars(source: str | Path, target: str | Path, patterns: list[str]) -> list[str]:
    """Copy the files whose paths match; those already there are left as they are."""
    source, target, done = Path(source), Path(target), []
    names = sorted(str(p.relative_to(source)) for p in source.rglob("*") if p.is_file()) if source.is_dir() else []
    for name in names:
        if any(fnmatch.fnmatch(name, p) for p in patterns):
            if (target / name).exists():
                log.warning("%s is already there and stays as it is", name)
                continue
            (target / name).parent.mkdir(parents=True, exist_ok=True)
            shutil.copy2(source / name, target / name)
            done.append(name)
    return done


class TrimPipeline:
    """Steps of a run over one configuration."""

    def __init__(self, spark: SparkSession, config: Config, document: TokenizerDocument | None = None) -> None:
        self.spark, self.config = spark, config
        self.document = document

    def load(self) -> TokenizerDocument:
        if self.document is None:
            self.document = TokenizerDocument.from_path(self.config.model)
        return self.document

    def count(self) -> Counts | None:
        corpus = self.config.corpus
        if not corpus.datasets and not (corpus.counts_cache and Path(corpus.counts_cache).exists()):
            return None
        return count_corpus(self.spark, self.load().to_json(), corpus, self.config.seed, self.config.verify_samples)

    def run(self, dry_run: bool = False) -> dict[str, Any]:
        """Do it all; a dry run stops after the selection and writes nothing."""
        config, document = self.config, self.load()
        counts = self.count()
        tables = document.tables(self.spark)
        selection = select_tokens(document, tables, counts, config.selection)
        report = self.report(selection, counts)
        if dry_run:
            return report
        out = guard(config.output_dir, config.overwrite)
        numbers = R.dense_remap(selection.kept)
        new = {r["old_id"]: r["new_id"] for r in numbers.collect()}  # of vocabulary size
        trimmed = TokenizerDocument(R.trim_document(document.raw, new), str(out), document.chat_template)
        if len(trimmed.vocabulary) != len(new):
            raise RuntimeError(f"the trimmed tokenizer has {len(trimmed.vocabulary)} tokens instead of {len(new)}")
        (out / "tokenizer.json").write_text(trimmed.to_json(), "utf-8")
        reloaded = TokenizerDocument.from_path(out / "tokenizer.json")
        if len(reloaded.vocabulary) != len(new):
            raise RuntimeError(f"the tokenizer that was written has {len(reloaded.vocabulary)} tokens instead of {len(new)}")
        for name in ("vocab", "merges"):
            reloaded.tables(self.spark)[name].write.mode("overwrite").parquet(str(out / f"{name}.parquet"))
        source = Path(config.model)
        settings = source / "tokenizer_config.json"
        if source.is_dir() and settings.exists():
            own = json.loads(settings.read_text("utf-8"))
            if "added_tokens_decoder" in own:
                own["added_tokens_decoder"] = R.trim_decoder(own["added_tokens_decoder"], new)
            (out / "tokenizer_config.json").write_text(json.dumps(own, indent=2, ensure_ascii=False), "utf-8")
        texts = [*config.selection.keep_texts, *(counts.samples if counts else [])]
        if config.verify and texts:
            report["verification"] = verify_tokenizer(self.spark, document.to_json(), trimmed.to_json(), numbers, texts)
        if config.trim_model:
            report["model_trim"] = self.trim_tables(source, out, numbers, new)
            if config.copy_sidecar_files:
                copy_sidecars(source, out, config.sidecar_patterns)
        report["output_dir"] = str(out)
        (out / REPORT).write_text(json.dumps(report, indent=2, ensure_ascii=False), "utf-8")
        (out / SETTINGS).write_text(config.to_text(), "utf-8")
        return report

    def trim_tables(self, source: Path, out: Path, numbers, new: dict[int, int]) -> dict[str, Any] | None:
        """Gather the rows of embedding, head and bias tables (Parquet) that lie with the tokenizer; renumber ``config.json``."""
        read = {n: self.spark.read.parquet(str(source / f"{n}.parquet")) for n in ("embedding", "head", "bias") if (source / f"{n}.parquet").exists()}
        config = source / "config.json"
        padding = None
        if config.is_file():
            padding = json.loads(config.read_text("utf-8")).get("pad_token_id")
            settings, lost = R.remap_settings(json.loads(config.read_text("utf-8")), new)
            for name in lost:
                log.warning("%s named a token that is gone", name)
            (out / "config.json").write_text(json.dumps(settings, indent=2), "utf-8")
        if "embedding" not in read:
            return None
        made = R.trim_model(read["embedding"], numbers, read.get("head"), read.get("bias"), self.config.embeddings.pad_to_multiple_of)
        mode = "overwrite" if self.config.overwrite else "error"
        for name, table in made.items():
            table.write.mode(mode).parquet(str(out / f"{name}.parquet"))
        vectors = [n for n in made if n != "bias"]
        before = sum(R.parameters(read[n]) for n in vectors) + (read["bias"].count() if "bias" in read else 0)
        after = sum(R.parameters(made[n]) for n in vectors) + (made["bias"].count() if "bias" in made else 0)
        return {"rows_before": read["embedding"].count(), "rows_after": made["embedding"].count(), "tokens": len(new), "padding_idx": R.padding_after(padding, numbers), "parameters_before": before, "parameters_after": after, "parameters_removed": before - after}

    def report(self, selection: Selection, counts: Counts | None) -> dict[str, Any]:
        before, after = len(self.load().vocabulary), selection.kept.count()
        dropped = {r["token_id"]: r["reasons"] for r in selection.dropped.orderBy("token_id").collect()}
        out: dict[str, Any] = {
            "model": self.config.model, "output_dir": None, "model_type": self.document.model_type, "vocab_before": before, "vocab_after": after,
            "reduction": 1 - after / before if before else 0.0, "structural": selection.kept.where("structural").count(), "kept_by_reason": selection.by_reason(),
            "dropped_requested": {self.document.id_to_token[i]: r for i, r in dropped.items()}, "unknown_tokens": selection.unknown, "missed_cap": selection.missed_cap,
            "corpus": None, "verification": None, "model_trim": None,
        }
        if counts is not None:
            kept = [r["token_id"] for r in selection.kept.select("token_id").collect()]
            out["corpus"] = {"documents": counts.documents, "tokens": counts.total, "distinct": counts.distinct(), "coverage": counts.coverage_of(kept)}
        return out


def render(report: dict[str, Any]) -> str:
    lines = [f"{report['model']} ({report['model_type']})", f"tokens     {report['vocab_before']:,} -> {report['vocab_after']:,} ({report['reduction']:.1%} removed)", f"structural {report['structural']:,}"]
    lines += [f"  {reason:24}{n:,}" for reason, n in report["kept_by_reason"].items()]
    if c := report["corpus"]:
        lines.append(f"corpus     {c['tokens']:,} tokens in {c['documents']:,} documents, {c['coverage']:.4%} covered")
    if report["dropped_requested"]:
        lines.append("dropped    " + ", ".join(map(repr, report["dropped_requested"])))
    if report["unknown_tokens"]:
        lines.append("unknown    " + ", ".join(map(repr, report["unknown_tokens"])))
    if v := report["verification"]:
        lines.append(f"verified   {v['identical']:,}/{v['checked']:,} identical, {v['equivalent']:,} equivalent, {v['length_ratio']:.4f}x tokens: {'ok' if v['ok'] else 'FAILED'}")
    if m := report["model_trim"]:
        lines.append(f"parameters {m['parameters_removed']:,} of {m['parameters_before']:,} removed")
    lines.append(f"written to {report['output_dir']}" if report["output_dir"] else "dry run: nothing written")
    return "\n".join(lines)
