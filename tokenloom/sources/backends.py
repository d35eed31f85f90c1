"""Model families: which tokens they can't do without, and which need others."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from tokenloom.functions.text import byte_alphabet

if TYPE_CHECKING:
    from tokenloom.sources.tokenizer import TokenizerDocument


class Backend:
    """What holds for every family: the unknown token is structural, no token needs another."""

    def structural(self, document: TokenizerDocument) -> set[str]:
        return {document.unk_token} if document.unk_token else set()

    def dependencies(self, tables: dict[str, DataFrame]) -> DataFrame | None:
        """child, parent, slot, or None."""
        return None


class _Fallback(Backend):
    def structural(self, document):
        own = super().structural(document)
        return own | {f"<0x{b:02X}>" for b in range(256)} if document.model.get("byte_fallback") else own


class _Merging(_Fallback):
    def structural(self, document):
        own = super().structural(document)
        return own | set(byte_alphabet()) if document.uses_byte_level else own

    def dependencies(self, tables):
        from tokenloom.operators.selection import merge_dependencies

        return merge_dependencies(tables["merges"], tables["vocab"])


_families: dict[str, Backend] = {"BPE": _Merging(), "Unigram": _Fallback(), "WordLevel": Backend(), "WordPiece": Backend()}


def register_backend(model_type: str, replace: bool = False):
    """Class decorator: make a Backend stand for documents of a model type."""

    def add(family: type[Backend]) -> type[Backend]:
        if model_type in _families and not replace:
            raise ValueError(f"there is a backend for {model_type!r} already")
        _families[model_type] = family()
        return family

    return add


def get_backend(model_type: str | None) -> Backend:
    if model_type not in _families:
        raise KeyError(f"no rules for tokenizer model type {model_type!r} (supported: {', '.join(supported_model_types())})")
    return _families[model_type]


def supported_model_types() -> list[str]:
    return sorted(_families)
