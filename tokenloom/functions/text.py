"""Scalar functions over token strings: white space as Python sees it, byte-level letters, surfaces, code points."""

from __future__ import annotations

import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.sources.scratch import spread

#: Characters that ``str.isspace`` accepts, for use within a character class (Java and RE2 agree on it).
SPACES = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Words of letters, marks, numbers and underscores, or runs of other visible characters.
WORD = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+"
PUNCTUATION = r"!-/:-@\[-`{-~"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", "")


def all_in(text: Column, members: str) -> Column:
    """Whether the stripped text isn't empty and has only characters of the class."""
    return strip(text).rlike(f"^[{members}]+$")


def words(text: Column) -> Column:
    """The lower-cased words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


@cache
def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable bytes of Latin-1 stand for themselves, the others for the code points from 256 on.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def byte_alphabet() -> list[str]:
    return sorted(byte_letters().values())


def byte_level_surface(token: Column) -> Column:
    """The text of a byte-level token, or null if it has other characters or no valid UTF-8."""
    codes = F.create_map(*[F.lit(x) for b, c in sorted(byte_letters().items()) for x in (c, f"{b:02X}")])
    digits = F.transform(F.split(token, ""), lambda c: F.element_at(codes, c))
    whole = F.forall(digits, lambda x: x.isNotNull())
    raw = F.unhex(F.array_join(digits, ""))
    return F.when(token == "", F.lit("")).when(whole, F.try_validate_utf8(raw.cast("string")))


def marked_surface(token: Column, continuing: str | None, initial: str | None) -> Column:
    """Without the continuation prefix, and with every word-start marker turned into a blank."""
    text = F.when(token.startswith(continuing), F.substring(token, len(continuing) + 1, 1 << 30)).otherwise(token) if continuing else token
    return F.replace(text, F.lit(initial), F.lit(" ")) if initial else text


KINDS = {"L": "letter", "N": "number", "P": "punctuation", "S": "symbol", "M": "mark"}


@cache
def _points() -> pa.Table:
    out = []
    for p in (*range(0x40000), *range(0xE0000, 0xE1000)):  # no other plane has assigned characters but private ones
        c = chr(p)
        major = unicodedata.category(c)
        if major in ("Cn", "Cs", "Co"):
            continue
        name = unicodedata.name(c, "")
        kind = "whitespace" if c.isspace() else KINDS.get(major[0], "other")
        if c.isalpha() or kind != "other":
            out.append((p, name if c.isalpha() else "", (name.split() or ["UNKNOWN"])[0] if c.isalpha() else "", c.isalpha(), kind))
    columns = zip(*out, strict=True)
    types = {"cp": pa.int32(), "name": pa.string(), "script": pa.string(), "is_alpha": pa.bool_(), "kind": pa.string()}
    return pa.table({name: pa.array(values, kind) for (name, kind), values in zip(types.items(), columns, strict=True)})


def codepoints(spark: SparkSession) -> DataFrame:
    """cp, name, script (the name's first word), is_alpha, kind: a fixed table of all letters and other classified code
    points, whatever the data's size."""
    return spark.createDataFrame(_points())


def characters(tokens: DataFrame, key: str = "token", surface: str = "surface") -> DataFrame:
    """One row for each character of each surface: key, pos, cp. Null and empty surfaces have none."""
    letters = F.posexplode(F.split(surface, "")).alias("pos", "c")
    return spread(tokens.where(F.col(surface).isNotNull() & (F.col(surface) != "")).select(key, surface), key).select(key, letters).where("c <> ''").select(key, "pos", F.ascii("c").alias("cp"))


def classified(tokens: DataFrame, key: str = "token", surface: str = "surface") -> DataFrame:
    """key, script and kind of each token by its characters.

    script: the one first word of its letters' names, ``mixed`` or ``non-letter``; kind: the most frequent, first
    seen among equals, ``other`` without characters; both ``partial-bytes`` for a null surface.
    """
    spark = tokens.sparkSession
    known = characters(tokens, key, surface).join(F.broadcast(codepoints(spark)), "cp", "left")
    known = known.withColumn("kind", F.coalesce("kind", F.lit("other")))
    kinds = known.groupBy(key, "kind").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.collect_set(F.when(F.col("is_alpha"), F.col("script"))).alias("scripts"))
    by = kinds.groupBy(key).agg(F.max_by("kind", F.struct("n", -F.col("first"))).alias("kind"), F.array_distinct(F.flatten(F.collect_list("scripts"))).alias("scripts"))
    script = F.when(F.size("scripts") == 0, "non-letter").when(F.size("scripts") == 1, F.col("scripts")[0]).otherwise("mixed")
    known = by.select(key, "kind", script.alias("script"))
    gone = F.col(surface).isNull()
    return tokens.select(key, surface).join(known, key, "left").select(
        key,
        F.when(gone, "partial-bytes").otherwise(F.coalesce("script", F.lit("non-letter"))).alias("script"),
        F.when(gone, "partial-bytes").otherwise(F.coalesce("kind", F.lit("other"))).alias("kind"),
    )


def in_script(tokens: DataFrame, script: str, key: str = "token", surface: str = "surface") -> DataFrame:
    """The tokens with a letter, all of whose letters' names begin with the script's name."""
    if not script.strip():
        raise ValueError("a script needs a name, as in 'script:Latin'")
    letters = characters(tokens, key, surface).join(F.broadcast(codepoints(tokens.sparkSession)).where("is_alpha"), "cp")
    return letters.groupBy(key).agg(F.min(F.col("name").startswith(script.strip().upper())).alias("all")).where("all").select(key)
