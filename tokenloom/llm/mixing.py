"""Mixing sources to target weights by entropy balancing.

Sources, in code-point order with null last, weigh 5, 2, 1, repeating. Their targets share all
words by weight, none above three times its own size (what is over is shared out again). For each source the
rates r of its documents solve

    minimise sum(r log r - r)   subject to   sum(r * size) = target,  0 <= r <= 3,

whose dual in one multiplier a source is convex: r = min(3, exp(lambda * size / mean size)).
Newton iterations, guarded by a bracket, solve it; each is one aggregation over counts by (source, size), on which
alone the rates depend. The rates of a (source, size) cell become a whole number of copies,
rounding errors being carried from larger to smaller sizes, so that a source ends near its
target; the cell's documents share its copies evenly, the remainder by hash order.

A null text has size 0. Documents of size 0 are taken once, which takes no words. A null source is a source. Ties
in hash order fall to the smaller doc_id; rows equal in both are interchangeable. An empty table gives an empty
result. Cells are split 64 ways by hash wherever documents, not counts, are handled, so a
hot source or size is no single task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.common import NOT_SPACE, column_bytes, cut, map_slices, per_row, text_or_empty, word_bounds

WEIGHTS = (5, 2, 1)
MOST = 3
SALTS = 64
TOLERANCE = 1e-9
ITERATIONS = 80


def _sizes(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = column_bytes(batch.column("text"))
    starts, _ = word_bounds(data, offsets, NOT_SPACE)
    size = np.diff(per_row(starts, offsets)).astype(np.int64)
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("hash"), pa.array(size)], names=["doc_id", "source", "hash", "size"])


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, hash and size (words between white space) of every row."""
    text = text_or_empty(docs)
    rows = docs.select(docs["doc_id"], docs["source"].cast("string").alias("source"), F.xxhash64(docs["doc_id"], text).alias("hash"), text.cast("binary").alias("text"))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("source", T.StringType()), T.StructField("hash", T.LongType()), T.StructField("size", T.LongType())])
    return map_slices(rows, _sizes, schema)


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add sid, weight and target to (source, source_size, source_docs); windows run over one row a source."""
    everywhere = W.partitionBy()
    ranked = totals.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    caps = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = W.orderBy("ratio", "sid").rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # Sources are capped from the lowest ratio on; the first whose level is below its own ratio sets the level of the rest.
    levels = caps.withColumn("level", level)
    final = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "sid", "level"))).over(everywhere)["level"]
    return levels.withColumn("final", final).select(
        "source", "sid", "source_size", "source_docs", "weight",
        F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("final"))).alias("target"),
    )


def solve(cells: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """Newton iterations on the dual: sid and multiplier of each source that is neither empty nor wholly at its cap."""
    top = math.log(most)
    ratio = F.col("target") / F.col("source_size")
    state = sources.where((F.col("source_size") > 0) & (ratio < most * (1 - 1e-12))).select(
        "sid", (F.col("target") / F.col("mean")).alias("goal"), F.log(ratio).alias("multiplier"),
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(1.0).alias("error"),
    )
    state = cut(state, "newton")
    u = F.col("multiplier") * F.col("load")
    rate = F.exp(F.least(u, F.lit(top)))
    for _ in range(ITERATIONS):
        sums = cells.join(state, "sid").groupBy("sid").agg(
            *[F.first(c).alias(c) for c in ("goal", "multiplier", "low", "high")],
            F.sum(F.col("n") * F.col("load") * rate).alias("reached"),
            F.sum(F.when(u < top, F.col("n") * F.col("load") * F.col("load") * rate).otherwise(0.0)).alias("slope"),
        )
        lam, gap = F.col("multiplier"), F.col("reached") - F.col("goal")
        sums = sums.withColumn("low", F.when(gap < 0, lam).otherwise(F.col("low"))).withColumn("high", F.when(gap >= 0, lam).otherwise(F.col("high")))
        newton = F.when(F.col("slope") > 0, lam - gap / F.col("slope"))
        inside = newton.isNotNull() & F.coalesce(newton > F.col("low"), F.lit(True)) & F.coalesce(newton < F.col("high"), F.lit(True))
        wide = F.greatest(F.lit(1.0), F.abs(lam))
        fallback = F.when(F.col("high").isNull(), lam + wide).when(F.col("low").isNull(), lam - wide).otherwise((F.col("low") + F.col("high")) / 2)
        error = F.abs(gap) / F.col("goal")
        state = cut(
            sums.select("sid", "goal", F.when(error <= TOLERANCE, lam).when(inside, newton).otherwise(fallback).alias("multiplier"), "low", "high", error.alias("error")),
            "newton",
        )
        worst = state.agg(F.max("error")).first()[0]
        if worst is None or worst <= TOLERANCE:
            return state.select("sid", "multiplier")
    raise ArithmeticError(f"rates are still {worst:.3g} of a target off after {ITERATIONS} iterations")


def carry_round(cells: pd.DataFrame, most: int = MOST) -> pd.DataFrame:
    """Whole copies for the cells of one source; a cell is a size, so the group has as many rows as there are sizes."""
    cells = cells.sort_values("size", ascending=False)
    copies, error = [], 0.0
    for size, n, rate in zip(cells["size"].tolist(), cells["n"].tolist(), cells["rate"].tolist(), strict=True):
        wanted = n * rate * size + error
        k = min(most * n, max(0, round(wanted / size)))
        copies.append(k)
        error = wanted - k * size
    return pd.DataFrame({"sid": cells["sid"], "size": cells["size"], "cell_copies": np.array(copies, np.int64)})


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Return doc_id, hash, size, source_size, target, rate, copies and taken for every row."""
    slim = cut(sizes(docs).withColumn("salt", F.pmod("hash", F.lit(SALTS)).cast("int")), "sizes")
    salted = cut(slim.groupBy("source", "size", "salt").agg(F.count("*").alias("n")), "cells")
    totals = salted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("source_docs"))
    sources = cut(targets(totals, weights, most).withColumn("mean", F.col("source_size") / F.col("source_docs")), "sources")
    named = sources.select(F.col("source").alias("_source"), "sid", "mean", "target", "source_size")
    cells = salted.where("size > 0").groupBy("source", "size").agg(F.sum("n").alias("n"))
    cells = cells.join(named, cells["source"].eqNullSafe(named["_source"]))
    cells = cut(cells.select("sid", "size", "n", (F.col("size") / F.col("mean")).alias("load")), "loads")
    multipliers = solve(cells, sources, most)
    rate = F.coalesce(F.exp(F.least(F.col("multiplier") * F.col("load"), F.lit(math.log(most)))), F.lit(float(most)))
    rated = cells.join(multipliers, "sid", "left").select("sid", "size", "n", rate.alias("rate"))
    limit = most
    rounded = rated.groupBy("sid").applyInPandas(lambda g: carry_round(g, limit), "sid int, size long, cell_copies long")
    plan = cut(rated.join(rounded, ["sid", "size"]), "copies")

    known = salted.join(named, salted["source"].eqNullSafe(named["_source"])).select("source", "size", "salt", salted["n"].alias("salt_n"), "sid", "source_size", "target")
    along = W.partitionBy("sid", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    shares = known.join(plan, ["sid", "size"], "left").withColumn("before", F.coalesce(F.sum("salt_n").over(along), F.lit(0)))
    extra = F.greatest(F.lit(0), F.least(F.col("salt_n"), F.expr("cell_copies % n") - F.col("before")))
    shares = shares.select(
        F.col("source").alias("_source"), "size", "salt", "source_size", "target", F.coalesce("rate", F.lit(1.0)).alias("rate"),
        F.coalesce(F.expr("cell_copies div n"), F.lit(1)).alias("base"), F.coalesce(extra, F.lit(0)).alias("extra"),
    )
    joined = slim.alias("d").join(shares.alias("s"), F.expr("d.source <=> s._source AND d.size = s.size AND d.salt = s.salt"))
    order = F.row_number().over(W.partitionBy("d.source", "d.size", "d.salt").orderBy("hash", "doc_id"))
    copies = F.col("base") + (order <= F.col("extra")).cast("long")
    return joined.withColumn("copies", copies).select("doc_id", "hash", "d.size", "source_size", "target", "rate", "copies", (F.col("d.size") * F.col("copies")).alias("taken"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed rows themselves: each row of ``docs``, with its own columns, as often as the mix takes it."""
    plan = mix(docs, weights, most).where("copies > 0").select(F.col("doc_id").alias("__mix_id"), F.col("hash").alias("__mix_of"), F.col("copies").alias("__mix_copies"))
    plan = plan.withColumn("__mix_k", F.row_number().over(W.partitionBy("__mix_of", "__mix_id").orderBy(F.desc("__mix_copies"))))
    rows = docs.withColumn("__mix_hash", F.xxhash64(docs["doc_id"], text_or_empty(docs))).withColumn("__mix_doc", docs["doc_id"])
    rows = rows.withColumn("__mix_n", F.row_number().over(W.partitionBy("__mix_hash", "__mix_doc").orderBy(F.lit(0))))
    chosen = rows.join(plan, F.expr("__mix_hash = __mix_of AND __mix_doc <=> __mix_id AND __mix_n = __mix_k"))
    times = F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))).alias("__mix_time")
    return chosen.select(*[docs[c] for c in docs.columns], times).drop("__mix_time")


def op5_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
