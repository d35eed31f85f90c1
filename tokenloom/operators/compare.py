"""Two vocabularies compared: as sets, by rules, scripts and kinds, and by what they make of texts."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenloom.functions.text import classified
from tokenloom.operators.presets import describe_presets, resolve_preset
from tokenloom.sources.scratch import cut

DECILES = 10
EXAMPLES = 5


def ratio(part: Column, whole: Column, empty: float = 1.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def vocabulary_diff(base: DataFrame, other: DataFrame) -> DataFrame:
    """One row: sizes, shared, removed, introduced, is_subset, ids_contiguous, order_preserved, removed_fraction.

    The order is kept if other ids rise with base ids.
    """
    both = base.select("token", F.col("token_id").alias("b")).join(other.select("token", F.col("token_id").alias("o")), "token", "full_outer")
    shared = F.col("b").isNotNull() & F.col("o").isNotNull()
    sums = both.agg(
        F.count("b").alias("base_size"), F.count("o").alias("other_size"), F.count_if(shared).alias("shared"),
        F.count_if(F.col("o").isNull()).alias("removed"), F.count_if(F.col("b").isNull()).alias("introduced"),
        F.min("o").alias("low"), F.max("o").alias("high"), F.count_distinct("o").alias("ids"),
    )
    order = order_preserved(both.where(shared).select("b", "o"))
    joined = sums.withColumn("_k", F.lit(1)).join(order.withColumn("_k", F.lit(1)), "_k")
    return joined.select(
        "base_size", "other_size", "shared", "removed", "introduced", (F.col("introduced") == 0).alias("is_subset"),
        F.coalesce((F.col("low") == 0) & (F.col("high") == F.col("other_size") - 1) & (F.col("ids") == F.col("other_size")), F.lit(True)).alias("ids_contiguous"),
        "order_preserved", ratio(F.col("removed"), F.col("base_size"), 0.0).alias("removed_fraction"),
    )


def order_preserved(pairs: DataFrame) -> DataFrame:
    """One row, order_preserved: whether ``o`` rises with ``b``. Range partitions are compared each by itself, then their first and last rows."""
    placed = cut(pairs.repartitionByRange("b").sortWithinPartitions("b").withColumn("_at", F.monotonically_increasing_id()), "order")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    before = F.lag("o").over(W.partitionBy("_part").orderBy("_at"))
    parts = placed.withColumn("ok", F.coalesce(before < F.col("o"), F.lit(True))).groupBy("_part").agg(F.min("ok").alias("ok"), F.min_by("o", "_at").alias("low"), F.max_by("o", "_at").alias("high"))
    edge = F.coalesce(F.lag("high").over(W.orderBy("_part")) < F.col("low"), F.lit(True))  # a row a partition
    return parts.withColumn("ok", F.col("ok") & edge).agg(F.coalesce(F.min("ok"), F.lit(True)).alias("order_preserved"))


def removed(base: DataFrame, other: DataFrame) -> DataFrame:
    return base.join(other.select("token"), "token", "left_anti")


def introduced(base: DataFrame, other: DataFrame, limit: int = 10) -> DataFrame:
    """The first tokens by code points that only the other vocabulary has."""
    return other.join(base.select("token"), "token", "left_anti").select("token").orderBy("token").limit(limit)


def removed_examples(base: DataFrame, other: DataFrame, limit: int = 10) -> DataFrame:
    """The lowest ids that are gone, with their surfaces."""
    return removed(base, other).orderBy("token_id").limit(limit)


def removed_deciles(base: DataFrame, other: DataFrame) -> DataFrame:
    """decile and removed: how many tokens went from each tenth of the base's ids."""
    spark = base.sparkSession
    span = base.agg(F.greatest(F.max("token_id") + 1, F.lit(1)).alias("span"))
    at = F.least(F.expr(f"cast(token_id as bigint) * {DECILES} div span"), F.lit(DECILES - 1))
    gone = removed(base, other).select("token_id").join(F.broadcast(span)).select(at.alias("decile"))  # a one-row table
    counted = gone.groupBy("decile").agg(F.count("*").alias("removed"))
    return spark.range(DECILES).select(F.col("id").alias("decile")).join(counted, "decile", "left").select("decile", F.coalesce("removed", F.lit(0)).alias("removed"))


def group_diff(grouped: DataFrame, kept: DataFrame, group: str) -> DataFrame:
    """group, base_tokens and kept of (token, group); largest first, then by name."""
    marked = grouped.join(kept.select("token").distinct().withColumn("_in", F.lit(1)), "token", "left")
    return marked.groupBy(group).agg(F.count("*").alias("base_tokens"), F.count("_in").alias("kept")).orderBy(F.desc("base_tokens"), group)


def encoding_diff(pairs: DataFrame) -> DataFrame:
    """One row of (text, base_tokens, other_tokens: arrays of token strings): checked, identical, tokens of either, rates."""
    n = pairs.agg(
        F.count("*").alias("checked"), F.count_if(F.col("base_tokens") == F.col("other_tokens")).alias("identical"),
        F.coalesce(F.sum(F.size("base_tokens")), F.lit(0)).alias("base_tokens"), F.coalesce(F.sum(F.size("other_tokens")), F.lit(0)).alias("other_tokens"),
    )
    return n.select("*", ratio(F.col("identical"), F.col("checked")).alias("identical_rate"), ratio(F.col("other_tokens"), F.col("base_tokens")).alias("length_ratio"))


def drifting(pairs: DataFrame, limit: int = EXAMPLES) -> DataFrame:
    """The texts (60 characters) whose number of tokens grew most among those that are split differently."""
    delta = F.size("other_tokens") - F.size("base_tokens")
    return pairs.where(F.col("base_tokens") != F.col("other_tokens")).select(delta.alias("delta"), F.substring("text", 1, 60).alias("text")).orderBy(F.desc("delta"), F.desc("text")).limit(limit)


def template_relation(base: str | None, other: str | None) -> str:
    if base and other:
        return "identical" if base == other else "changed"
    return "only in base" if base else "only in other" if other else "absent"


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def compare_tokenizers(spark, base, other, texts: list[str] | None = None, presets: list[str] | None = None, examples: int = 10) -> dict[str, Any]:
    """The whole comparison of two documents as nested records; everything is attributed against ``base``."""
    from tokenloom.operators.encode import encode

    b, o = base.tables(spark), other.tables(spark)
    mine, theirs = b["vocab"].persist(), o["vocab"].persist()
    kept = mine.join(theirs.select("token"), "token", "left_semi").select("token")
    vocabulary = _rows(vocabulary_diff(mine, theirs))[0] | {"introduced_examples": [r["token"] for r in introduced(mine, theirs, examples).collect()]}
    gone = lambda tokens: [t for t in tokens if t not in other.vocabulary]
    posts = sorted((t for t in base.post_tokens if t in base.vocabulary), key=base.vocabulary.__getitem__)
    components: dict[str, Any] = {}
    for side, doc in (("base", base), ("other", other)):
        about = doc.describe()
        components |= {f"{side}_{k}": about[k] for k in ("model_type", "uses_byte_level", "unk_token", "added_tokens", "special_tokens")}
    components |= {
        "removed_added_tokens": gone(t["content"] for t in base.added), "removed_special_tokens": gone(t["content"] for t in base.added if t.get("special")),
        "removed_post_processor_tokens": gone(posts), "chat_template": template_relation(base.chat_template, other.chat_template),
    }
    components["structural_break"] = any(components[f"removed_{k}_tokens"] for k in ("added", "special", "post_processor"))
    always = {name: kept_always for name, kept_always, _ in describe_presets() if ":" not in name}
    members = None
    for i, name in enumerate([*always, *(presets or [])]):
        found = resolve_preset(name, base, b).select("token", F.lit(i).alias("ord"), F.lit(name).alias("name"))
        members = found if members is None else members.unionByName(found)
    marked = members.join(kept.withColumn("_in", F.lit(1)), "token", "left").groupBy("ord", "name").agg(F.count("*").alias("base_tokens"), F.count("_in").alias("kept")).orderBy("ord")
    kinds = classified(mine).persist()
    profile = {
        "presets": [{"name": r["name"], "base_tokens": r["base_tokens"], "kept": r["kept"], "always_kept": always.get(r["name"], False)} for r in marked.collect()],
        "scripts": [{"name": r["script"], "base_tokens": r["base_tokens"], "kept": r["kept"]} for r in group_diff(kinds.select("token", "script"), kept, "script").collect()],
        "categories": [{"name": r["kind"], "base_tokens": r["base_tokens"], "kept": r["kept"]} for r in group_diff(kinds.select("token", "kind"), kept, "kind").collect()],
        "removed_by_decile": [r["removed"] for r in removed_deciles(mine, theirs).orderBy("decile").collect()],
        "removed_examples": _rows(removed_examples(mine, theirs, examples).select("token", "token_id", "surface")),
    }
    encoding = None
    if texts:
        rows = spark.createDataFrame(list(enumerate(texts)), "ord int, text string")
        coded = rows
        for doc, name in ((base, "base_tokens"), (other, "other_tokens")):
            ids = encode(rows, doc.to_json(), ["ord"]).select("ord", F.posexplode("ids").alias("pos", "token_id")).join(doc.tables(spark)["vocab"].select("token", "token_id"), "token_id")
            tokens = F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"])
            coded = coded.join(ids.groupBy("ord").agg(tokens.alias(name)), "ord", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
        encoding = _rows(encoding_diff(coded))[0] | {"examples": [r["text"] for r in drifting(coded).collect()]}
    for t in (mine, theirs, kinds):
        t.unpersist()
    return {"base": base.source or "base", "other": other.source or "other", "vocabulary": vocabulary, "components": components, "profile": profile, "encoding": encoding}


BARS = "▁▂▃▄▅▆▇█"


def sparkline(counts: list[int]) -> str:
    peak = max(counts, default=0)
    return "".join(BARS[round(c * 7 / peak) if peak else 0] for c in counts)


def render(report: dict[str, Any]) -> str:
    v, c, p, e = report["vocabulary"], report["components"], report["profile"], report["encoding"]
    lines = [
        f"{report['base']} -> {report['other']}", f"tokens            {v['base_size']:,} -> {v['other_size']:,} ({v['removed_fraction']:.1%} removed)",
        f"introduced        {v['introduced']:,}" + (f" ({', '.join(v['introduced_examples'])})" if v["introduced_examples"] else ""),
        f"relation          {'subset' if v['is_subset'] else 'not a subset'}, {'contiguous ids' if v['ids_contiguous'] else 'gaps in the ids'}, {'original order' if v['order_preserved'] else 'reordered'}",
        f"type              {c['base_model_type']} -> {c['other_model_type']}", f"unk               {c['base_unk_token']} -> {c['other_unk_token']}", f"chat template     {c['chat_template']}",
    ]
    if c["structural_break"]:
        lines.append("BROKEN            lost " + ", ".join(dict.fromkeys([*c["removed_added_tokens"], *c["removed_special_tokens"], *c["removed_post_processor_tokens"]])))
    for title in ("presets", "scripts", "categories"):
        lines.append(title)
        lines += [f"  {g['name']:24}{g['kept']:,}/{g['base_tokens']:,}" for g in p[title]]
    lines.append(f"removed by decile {sparkline(p['removed_by_decile'])}  {' '.join(map(str, p['removed_by_decile']))}")
    if p["removed_examples"]:
        lines.append("removed first     " + ", ".join(f"{r['token']!r} ({r['token_id']})" for r in p["removed_examples"]))
    if e:
        lines.append(f"encoding          {e['identical']:,}/{e['checked']:,} texts alike, {e['length_ratio']:.4f}x as many tokens")
        lines += [f"  {t!r}" for t in e["examples"]]
    return "\n".join(lines)


def save(report: dict[str, Any], path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report, indent=2, ensure_ascii=False), "utf-8")
