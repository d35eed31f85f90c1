"""Named rules over a vocabulary, and a registry for more."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import text as T
from tokenloom.sources.tokenizer import TokenizerDocument


@dataclass(frozen=True)
class Preset:
    name: str
    always_kept: bool
    rule: Callable
    doc: str


_plain: dict[str, Preset] = {}
_with_argument: dict[str, Preset] = {}


def register_preset(name: str, always_kept: bool = False):
    """Register a rule (document, tables) -> DataFrame with a column token."""
    if ":" in name:
        raise ValueError(f"a preset's name has no colon: {name!r}")

    def add(rule):
        if name in _plain:
            raise ValueError(f"preset {name!r} is already registered")
        _plain[name] = Preset(name, always_kept, rule, (rule.__doc__ or "").strip().split("\n")[0])
        return rule

    return add


def register_parametrised_preset(prefix: str):
    """Register a rule (document, tables, argument) -> DataFrame, named as ``prefix:argument``."""

    def add(rule):
        if prefix in _with_argument:
            raise ValueError(f"preset {prefix!r} is already registered")
        _with_argument[prefix] = Preset(prefix, False, rule, (rule.__doc__ or "").strip().split("\n")[0])
        return rule

    return add


#: Rules on the surface alone; a null surface matches none.
SURFACE_RULES: dict[str, Callable[[Column], Column]] = {
    "single_characters": lambda s: F.length(T.strip(s)) == 1,
    "ascii_letters": lambda s: T.all_in(s, "A-Za-z"),
    "digits": lambda s: T.all_in(s, "0-9"),
    "alphanumeric": lambda s: T.all_in(s, "A-Za-z0-9"),
    "punctuation": lambda s: T.all_in(s, T.PUNCTUATION),
    "whitespace": lambda s: s.rlike(f"^[{T.SPACES}]+$"),
    "ascii_printable": lambda s: s.rlike(r"^[\t-\r -~]+$"),
}
_DOCS = {
    "single_characters": "Tokens of one character, white space aside.", "ascii_letters": "Tokens of ASCII letters only.", "digits": "Tokens of ASCII digits only.",
    "alphanumeric": "Tokens of ASCII letters and digits only.", "punctuation": "Tokens of ASCII punctuation only.", "whitespace": "Tokens of white space only.", "ascii_printable": "Tokens of printable ASCII only.",
}


def _surface_rule(name: str):
    def rule(document, tables):
        return tables["vocab"].where(F.col("surface").isNotNull() & SURFACE_RULES[name](F.col("surface"))).select("token")

    rule.__doc__ = _DOCS[name]
    return rule


for _name in SURFACE_RULES:
    register_preset(_name)(_surface_rule(_name))


@register_preset("structural", always_kept=True)
def _structural(document, tables):
    """All tokens without which the tokenizer breaks."""
    return tables["structural"].select("token")


@register_preset("added_tokens", always_kept=True)
def _added(document, tables):
    """The document's added tokens."""
    return tables["added"].select(F.col("content").alias("token"))


@register_preset("special_tokens", always_kept=True)
def _special(document, tables):
    """Added tokens flagged as special."""
    return tables["added"].where("special").select(F.col("content").alias("token"))


@register_preset("unk", always_kept=True)
def _unk(document, tables):
    """The unknown token, if there is one."""
    return tables["vocab"].where(F.col("token") == F.lit(document.unk_token)).select("token")


@register_preset("byte_alphabet", always_kept=True)
def _bytes(document, tables):
    """The letters that stand for bytes, in a byte-level vocabulary."""
    return tables["vocab"].where(F.col("token").isin(T.byte_alphabet()) if document.uses_byte_level else F.lit(False)).select("token")


@register_parametrised_preset("script")
def _script(document, tables, argument):
    """Tokens whose letters all belong to a script, as in script:Latin."""
    return T.in_script(tables["vocab"].select("token", "surface"), argument)


def resolve_preset(name: str, document: TokenizerDocument, tables: dict[str, DataFrame]) -> DataFrame:
    """The tokens of a preset; plain names come before ``prefix:argument``."""
    if name in _plain:
        return _plain[name].rule(document, tables).distinct()
    prefix, colon, argument = name.partition(":")
    if colon and prefix in _with_argument:
        return _with_argument[prefix].rule(document, tables, argument).distinct()
    raise KeyError(f"unknown preset {name!r}; there are {', '.join(available_presets())}")


def available_presets() -> list[str]:
    return [*sorted(_plain), *[f"{p}:<argument>" for p in sorted(_with_argument)]]


def describe_presets() -> list[tuple[str, bool, str]]:
    return [(n, (p := (_plain | {f"{k}:<argument>": v for k, v in _with_argument.items()})[n]).always_kept, p.doc) for n in available_presets()]


def render_presets() -> str:
    return "\n".join(f"{name:24}{'always kept  ' if kept else '':13}{doc}" for name, kept, doc in describe_presets())
