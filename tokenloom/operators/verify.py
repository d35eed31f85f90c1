"""Proof that a trim changed nothing it shouldn't: re-encoded texts, and tables of activations."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.operators.compare import ratio
from tokenloom.operators.remap import map_sequences

FAILURES = 5
UNBOUNDED = 1_000_000


def verdicts(pairs: DataFrame) -> DataFrame:
    """Add identical (new ids are the old ones renumbered) and equivalent (or else the decoded texts agree) to rows with
    mapped, new_ids, old_text, new_text."""
    identical = F.coalesce(F.col("mapped") == F.col("new_ids"), F.lit(False))
    return pairs.withColumn("identical", identical).withColumn("equivalent", identical | (F.col("old_text") == F.col("new_text")))


def tally(judged: DataFrame) -> DataFrame:
    """One row: checked, identical, equivalent, old_tokens, new_tokens, rates and ok."""
    n = judged.agg(
        F.count("*").alias("checked"), F.count_if("identical").alias("identical"), F.count_if("equivalent").alias("equivalent"),
        F.coalesce(F.sum(F.size("old_ids")), F.lit(0)).alias("old_tokens"), F.coalesce(F.sum(F.size("new_ids")), F.lit(0)).alias("new_tokens"),
    )
    return n.select(
        "*", ratio(F.col("identical"), F.col("checked")).alias("exact_rate"), ratio(F.col("equivalent"), F.col("checked")).alias("text_rate"),
        ratio(F.col("new_tokens"), F.col("old_tokens")).alias("length_ratio"), (F.col("equivalent") == F.col("checked")).alias("ok"),
    )


def failures(judged: DataFrame, order: str = "ord", limit: int = FAILURES) -> DataFrame:
    """The first texts (200 characters) that don't survive."""
    return judged.where("NOT equivalent").orderBy(order).limit(limit).select(F.substring("text", 1, 200).alias("text"))


def verify_tokenizer(spark, old: str, new: str, remap: DataFrame, texts: list[str]) -> dict[str, Any]:
    """Encode texts with two documents and compare through the renumbering."""
    from tokenloom.operators.encode import decode, encode

    rows = spark.createDataFrame(list(enumerate(texts)), "ord int, text string")
    was, now = encode(rows, old, ["ord"]), encode(rows, new, ["ord"])
    mapped = map_sequences(was, remap, "ord").select("ord", F.col("ids").alias("mapped"))
    old_text = decode(was, old, ["ord"]).select("ord", F.col("text").alias("old_text"))
    new_text = decode(now, new, ["ord"]).select("ord", F.col("text").alias("new_text"))
    pairs = rows.join(was.select("ord", F.col("ids").alias("old_ids")), "ord").join(now.select("ord", F.col("ids").alias("new_ids")), "ord").join(mapped, "ord").join(old_text, "ord").join(new_text, "ord")
    judged = verdicts(pairs).persist()
    out = tally(judged).first().asDict() | {"failures": [r["text"] for r in failures(judged).collect()]}
    judged.unpersist()
    return out


def max_abs_diff(a: DataFrame, b: DataFrame, key: str = "row_id", vec: str = "vec") -> DataFrame:
    """One row, max_abs_diff: the largest difference between elements at the same place of rows with the same key."""
    pairs = a.select(key, F.col(vec).alias("_a")).join(b.select(key, F.col(vec).alias("_b")), key)
    each = F.array_max(F.zip_with("_a", "_b", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return pairs.agg(F.coalesce(F.max(each), F.lit(0.0)).alias("max_abs_diff"))


def logit_diff(old: DataFrame, new: DataFrame, remap: DataFrame, key: str = "row_id", vec: str = "vec") -> DataFrame:
    """As max_abs_diff, where the old rows' columns are first picked by the renumbering (padding columns of the new are left out)."""
    each = old.select(key, F.posexplode(vec).alias("old_id", "x")).join(remap, "old_id")
    picked = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("new_id", "x"))), lambda s: s["x"]).alias(vec))
    size = remap.count()
    return max_abs_diff(picked, new.select(key, F.slice(vec, 1, size).alias(vec)), key, vec)


def model_ok(hidden: float, logits: float | None, tolerance: float = 1e-5) -> bool:
    return max(hidden, logits or 0.0) <= tolerance


def length_limit(bounds: list[int | None]) -> int | None:
    """The least positive bound below a million, if any."""
    return min((b for b in bounds if b is not None and 0 < b < UNBOUNDED), default=None)
