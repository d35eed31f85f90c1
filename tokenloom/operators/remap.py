"""Dense renumbering of survivors and everything that follows it: sequences, rows, settings."""

from __future__ import annotations

import logging
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tokenloom.operators.ranking import ranked
from tokenloom.sources.scratch import lookup_side

log = logging.getLogger(__name__)


def dense_remap(kept: DataFrame, key: str = "token_id") -> DataFrame:
    """old_id, new_id: survivors numbered from 0 in their old order."""
    if kept.where(F.col(key) < 0).limit(1).count():
        raise ValueError("token ids cannot be negative")
    rows = ranked(kept.select(F.col(key).alias("old_id")).distinct(), [F.asc("old_id")])
    return rows.select("old_id", (F.col("rk") - 1).cast("int").alias("new_id"))


def remap_between(old: DataFrame, new: DataFrame) -> DataFrame:
    """old_id, new_id by token; every token of ``new`` must be in ``old`` and be numbered 0..n-1."""
    extra = new.join(old.select("token"), "token", "left_anti").orderBy("token").limit(5).collect()
    if extra:
        raise ValueError(f"tokens that the old vocabulary hasn't: {[r['token'] for r in extra]}")
    n, low, high, ids = new.agg(F.count("*"), F.min("token_id"), F.max("token_id"), F.count_distinct("token_id")).first()
    if n and (low != 0 or high != n - 1 or ids != n):
        raise ValueError("the new ids are not 0..n-1")
    return old.select("token", F.col("token_id").alias("old_id")).join(new.select("token", F.col("token_id").alias("new_id")), "token").select("old_id", "new_id")


def to_new(ids: DataFrame, remap: DataFrame, column: str = "token_id") -> DataFrame:
    """Rows with ``new_id``, null where the token is gone."""
    return ids.join(remap.select(F.col("old_id").alias(column), "new_id"), column, "left")


def to_old(ids: DataFrame, remap: DataFrame, column: str = "token_id") -> DataFrame:
    """Rows of new ids with ``old_id``, null where there is no such new id."""
    return ids.join(remap.select(F.col("new_id").alias(column), "old_id"), column, "left")


def surviving(ids: DataFrame, remap: DataFrame, column: str = "token_id") -> DataFrame:
    """The rows whose token is kept."""
    return ids.join(remap.select(F.col("old_id").alias(column)), column, "left_semi")


def padding_after(padding_idx: int | None, remap: DataFrame) -> int | None:
    """A table's padding row under its new number; none, with a warning, where that token is gone."""
    if padding_idx is None:
        return None
    found = remap.where(F.col("old_id") == padding_idx).first()
    if found is None:
        log.warning("the padding row %d was dropped, so the table has none any more", padding_idx)
    return None if found is None else found["new_id"]


def map_sequences(sequences: DataFrame, remap: DataFrame, key: str, ids: str = "ids") -> DataFrame:
    """key and ids in new numbers, null if any of them is gone; an empty sequence stays empty."""
    each = sequences.select(key, F.posexplode_outer(ids).alias("pos", "old_id"))
    joined = each.join(lookup_side(remap), "old_id", "left")
    whole = F.count("new_id") == F.count("old_id")
    order = F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "new_id")))), lambda x: x["new_id"])
    return joined.groupBy(key).agg(F.when(whole, order).alias(ids))


def gather_rows(table: DataFrame, remap: DataFrame, pad_to: int | None = None, row: str = "row_id", vec: str = "vec") -> DataFrame:
    """row_id, vec: the survivors' rows under their new numbers, followed by rows of zeros up to a multiple of ``pad_to``."""
    missing = remap.join(table.select(F.col(row).alias("old_id")), "old_id", "left_anti").orderBy("old_id").first()
    if missing is not None:
        raise ValueError(f"id {missing['old_id']} has no row in the table")
    out = table.join(remap, table[row] == remap["old_id"]).select(F.col("new_id").alias("row_id"), vec)
    if pad_to:
        n = remap.count()
        more = -n % pad_to
        if more:
            kind = table.schema[vec].dataType
            zero = F.transform(vec, lambda x: F.lit(0).cast(kind.elementType)) if isinstance(kind, ArrayType) else F.lit(0).cast(kind)
            like = table.select(zero.alias(vec)).limit(1)
            new = F.explode(F.sequence(F.lit(n), F.lit(n + more - 1)))
            out = out.unionByName(like.select(new.alias("row_id"), vec))
    return out


def trim_model(embedding: DataFrame, remap: DataFrame, head: DataFrame | None = None, bias: DataFrame | None = None, pad_to: int | None = None) -> dict[str, DataFrame]:
    """The input table, an untied head and a head's bias, gathered by the same numbers (the bias also when the head is tied)."""
    out = {"embedding": gather_rows(embedding, remap, pad_to)}
    if head is not None:
        out["head"] = gather_rows(head, remap, pad_to)
    if bias is not None:
        out["bias"] = gather_rows(bias, remap, pad_to, vec="b")
    return out


def parameters(table: DataFrame, vec: str = "vec") -> int:
    return table.agg(F.sum(F.size(vec))).first()[0] or 0


def remap_config(config_ids: DataFrame, remap: DataFrame) -> DataFrame:
    """path, attr, is_list, ids: a single id becomes its new one or null, a list keeps its survivors in order."""
    each = config_ids.select("path", "attr", "is_list", F.posexplode_outer("ids").alias("pos", "old_id")).join(remap, "old_id", "left")
    order = F.transform(F.array_sort(F.collect_list(F.when(F.col("new_id").isNotNull(), F.struct("pos", "new_id")))), lambda x: x["new_id"])
    back = each.groupBy("path", "attr", "is_list").agg(order.alias("ids"))
    return back.withColumn("ids", F.when(F.col("is_list") | (F.size("ids") > 0), F.col("ids")))


def remap_settings(settings: dict, new: dict[int, int]) -> tuple[dict, list[str]]:
    """A settings tree with all ``*token_id`` and ``*token_ids`` values renumbered; names of single ids that are gone."""
    lost: list[str] = []

    def walk(node: Any, path: str) -> Any:
        if not isinstance(node, dict):
            return node
        out = {}
        for key, value in node.items():
            at = f"{path}.{key}" if path else key
            if key.endswith(("token_id", "token_ids")) and not isinstance(value, bool) and isinstance(value, (int, list)):
                if isinstance(value, list):
                    out[key] = [new[i] for i in value if i in new]
                else:
                    out[key] = new.get(value)
                    lost.extend([at] * (value not in new))
            else:
                out[key] = walk(value, at)
        return out

    return walk(settings, ""), lost


def trim_document(raw: dict, new: dict[int, int]) -> dict:
    """A tokenizer document with only the survivors, renumbered wherever ids stand: vocabulary, merges, added tokens,
    post-processor, padding, the unknown piece."""
    import copy

    out = copy.deepcopy(raw)
    model = out["model"]
    added = {t["content"]: t["id"] for t in out.get("added_tokens") or []}
    if model["type"] == "Unigram":
        pieces = model["vocab"]
        model["vocab"] = [p for i, p in enumerate(pieces) if i in new]
        if model.get("unk_id") is not None:
            model["unk_id"] = new.get(model["unk_id"])
        tokens = {p[0] for p in model["vocab"]}
    else:
        model["vocab"] = {t: new[i] for t, i in sorted(model["vocab"].items(), key=lambda x: x[1]) if i in new}
        tokens = set(model["vocab"])
    tokens |= {t for t, i in added.items() if i in new}
    if model.get("merges"):
        split = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        model["merges"] = [m for m, (a, b) in zip(model["merges"], split, strict=True) if a in tokens and b in tokens and a + b in tokens]
    if out.get("added_tokens"):
        out["added_tokens"] = [t | {"id": new[t["id"]]} for t in out["added_tokens"] if t["id"] in new]

    def walk(node: Any) -> None:
        if isinstance(node, list):
            for x in node:
                walk(x)
        elif isinstance(node, dict):
            special = node.get("special_tokens")
            if isinstance(special, dict):
                for entry in special.values():
                    if isinstance(entry, dict) and isinstance(entry.get("ids"), list):
                        entry["ids"] = [new[i] for i in entry["ids"] if i in new]
            for key in ("sep", "cls"):
                if isinstance(node.get(key), list) and len(node[key]) == 2 and isinstance(node[key][1], int):
                    node[key][1] = new.get(node[key][1])
            for key in ("processors",):
                walk(node.get(key))

    walk(out.get("post_processor"))
    if isinstance(out.get("padding"), dict) and out["padding"].get("pad_id") is not None:
        out["padding"]["pad_id"] = new.get(out["padding"]["pad_id"])
    return out


def trim_decoder(added_tokens_decoder: dict[str, Any], new: dict[int, int]) -> dict[str, Any]:
    """``added_tokens_decoder`` under new ids, without what is gone."""
    return {str(new[int(i)]): x for i, x in added_tokens_decoder.items() if int(i) in new}
