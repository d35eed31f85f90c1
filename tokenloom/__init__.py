"""Vocabulary analysis and reduction at corpus scale on Spark, with operators for training corpora beside it."""

from __future__ import annotations

from importlib import import_module
from typing import Any

#: Public names and the modules that hold them; these are imported when first asked for.
_PLACES = {
    "tokenloom.errors": ("MissingDependencyError",),
    "tokenloom.logs": ("show_messages",),
    "tokenloom.operators.compare": ("compare_tokenizers",),
    "tokenloom.operators.counting": ("Counts", "count_corpus", "count_occurrences", "count_weighted", "coverage_of"),
    "tokenloom.operators.encode": ("count_tokens", "decode", "encode", "encode_wordlevel", "unigram_of", "wordpiece_of"),
    "tokenloom.operators.presets": ("available_presets", "describe_presets", "register_parametrised_preset", "register_preset", "resolve_preset"),
    "tokenloom.operators.remap": ("dense_remap", "gather_rows", "map_sequences", "remap_between", "surviving", "to_new", "to_old", "trim_document", "trim_model"),
    "tokenloom.operators.selection": ("Selection", "apply_cap", "cut_by_corpus", "expand_dependencies", "merge_dependencies", "select_tokens"),
    "tokenloom.operators.verify": ("logit_diff", "max_abs_diff", "verify_tokenizer"),
    "tokenloom.plans.config": ("Config", "Corpus", "Dataset", "Embeddings", "Selecting", "load_config"),
    "tokenloom.plans.run": ("TrimPipeline", "render"),
    "tokenloom.sources.backends": ("Backend", "get_backend", "register_backend", "supported_model_types"),
    "tokenloom.sources.corpus": ("open_dataset", "sample", "texts"),
    "tokenloom.sources.tokenizer": ("TokenizerDocument",),
}
_WHERE = {name: module for module, names in _PLACES.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str) -> Any:
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(_WHERE[name]), name)


def __dir__() -> list[str]:
    return sorted([*globals(), *__all__])
