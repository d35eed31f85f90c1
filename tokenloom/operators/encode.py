"""Encoders: texts to token ids, and back.

Word-level and WordPiece vocabularies encode by joins over the distinct words; every family also runs through its
tokenizer document in Arrow batches, where counts are summed before anything is shuffled.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import words
from tokenloom.sources import scratch
from tokenloom.sources.scratch import lookup_side, spread


def _marked(found: DataFrame, vocab: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Adds ``_hot`` and, of hot words, ``_id``. ``hot``: the words that occur most, by default as a count of them finds them."""
    if hot is None:
        counts = found.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
        hot = counts.orderBy(F.desc("n"), "token").limit(scratch.BROADCAST_ROWS)
    known = hot.select("token").join(vocab, "token", "left").select("token", F.lit(True).alias("_hot"), F.col("token_id").alias("_id"))
    return found.join(F.broadcast(known), "token", "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))


def encode_wordlevel(docs: DataFrame, vocab: DataFrame, key: str = "doc_id", unk: int | None = None, pieces: Column | None = None, hot: DataFrame | None = None) -> DataFrame:
    """key, pos, token, token_id for each word; unknown words get ``unk`` (or none, left null).

    Of a vocabulary too large to be broadcast the hot words are; only the rows of others meet by their word, so no frequent word is one
    task. ``hot``: as many words as may be broadcast, the most frequent ones, where they are known.
    """
    found = docs.select(key, F.posexplode(pieces if pieces is not None else words(F.col("text"))).alias("pos", "token"))
    vocab = vocab.select("token", "token_id")
    if vocab.count() <= scratch.BROADCAST_ROWS:
        joined = found.join(F.broadcast(vocab), "token", "left")
    else:
        alone = F.concat_ws("\n", F.lit(""), F.col(key).cast("string"), "pos")
        rows = _marked(found, vocab, hot).withColumn("_key", F.when(F.col("_hot"), alone).otherwise(F.col("token")))
        joined = rows.join(vocab.select(F.col("token").alias("_key"), "token_id"), "_key", "left")
        joined = joined.withColumn("token_id", F.when(F.col("_hot"), F.col("_id")).otherwise(F.col("token_id")))
    return joined.select(key, "pos", "token", (F.coalesce("token_id", F.lit(unk)) if unk is not None else F.col("token_id")).alias("token_id"))


def sum_wordlevel(docs: DataFrame, vocab: DataFrame, key: str = "doc_id", unk: int = -1, pieces: Column | None = None, hot: DataFrame | None = None) -> DataFrame:
    """key, n_tokens, n_unknown and id_sum of each text with words, unknown words having the id ``unk``: what ``encode_wordlevel`` gives, summed.
    Hot words are summed by text before anything is shuffled."""
    found = docs.select(key, F.explode(pieces if pieces is not None else words(F.col("text"))).alias("token"))
    vocab = vocab.select("token", "token_id")
    if vocab.count() <= scratch.BROADCAST_ROWS:
        parts = found.join(F.broadcast(vocab), "token", "left").select(key, F.lit(1).cast("long").alias("n"), F.when(F.col("token_id").isNull(), 1).otherwise(0).alias("lost"), F.col("token_id").cast("long").alias("ids"))
    else:
        alone = F.concat_ws("\n", F.lit(""), F.col(key).cast("string"))
        rows = _marked(found, vocab, hot).withColumn("_key", F.when(F.col("_hot"), alone).otherwise(F.col("token")))
        each = rows.groupBy(key, "_hot", "_key").agg(F.count("*").alias("n"), F.count_if(F.col("_id").isNull()).alias("_lost"), F.sum("_id").alias("_ids"))
        joined = each.join(vocab.select(F.col("token").alias("_key"), "token_id"), "_key", "left")
        cold = F.when(F.col("token_id").isNull(), F.col("n")).otherwise(0)
        parts = joined.select(key, "n", F.when(F.col("_hot"), F.col("_lost")).otherwise(cold).alias("lost"), F.when(F.col("_hot"), F.col("_ids")).otherwise(F.col("token_id") * F.col("n")).alias("ids"))
    sums = parts.groupBy(key).agg(F.sum("n").alias("n_tokens"), F.sum("lost").alias("n_unknown"), F.coalesce(F.sum("ids"), F.lit(0)).alias("ids"))
    return sums.select(key, "n_tokens", "n_unknown", (F.col("ids") + F.lit(unk) * F.col("n_unknown")).cast("long").alias("id_sum"))


def wordpiece_of(distinct: DataFrame, vocab: DataFrame, unk: int, prefix: str = "##", most: int = 100) -> DataFrame:
    """token and its ids (array) for distinct words: greedily the longest piece from each place.

    Pieces are looked up as whole strings (with the prefix unless at the word's start); the best length at each place is
    then folded from left to right. A word with a place where nothing fits, or of more than ``most`` characters, is unknown.
    """
    size = F.length("token")
    short = spread(distinct.where(size <= most), "token")
    longest, n = vocab.agg(F.coalesce(F.max(F.length("token")), F.lit(0)), F.count("*")).first()  # no longer span can be a piece
    spans = short.select("token", F.explode(F.sequence(F.lit(1), size)).alias("at"))
    spans = spans.select("token", "at", F.explode(F.sequence(F.lit(1), F.least(F.length("token") - F.col("at") + 1, F.greatest(F.lit(longest), F.lit(1))))).alias("len"))
    piece = F.expr("substring(token, at, len)")
    spans = spans.withColumn("piece", F.when(F.col("at") == 1, piece).otherwise(F.concat(F.lit(prefix), piece)))
    hits = spans.join(lookup_side(vocab.select(F.col("token").alias("piece"), "token_id"), n), "piece")
    best = hits.groupBy("token", "at").agg(F.max(F.struct("len", "token_id")).alias("best"))
    by_word = best.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("at", "best"))).alias("places"))
    fold = """
        aggregate(sequence(1, length(token)), named_struct('at', 1, 'ids', cast(array() as array<int>)),
            (s, i) -> if(s.at <> i, s, if(map_contains_key(places, i),
                named_struct('at', cast(i + places[i].len as int), 'ids', concat(s.ids, array(places[i].token_id))), named_struct('at', -1, 'ids', s.ids))),
            s -> if(s.at = length(token) + 1, s.ids, null))
    """
    folded = by_word.select("token", F.expr(fold).alias("ids"))
    return distinct.join(folded, "token", "left").select("token", F.coalesce("ids", F.array(F.lit(unk))).alias("ids"))


UNKNOWN_PENALTY = 10.0


def unigram_of(distinct: DataFrame, pieces: DataFrame, unk: int, most: int = 100) -> DataFrame:
    """token and its ids (array) for distinct words: the segmentation of the greatest sum of scores, the longer last piece where
    sums are equal. ``pieces``: token, token_id, score.

    Spans are looked up as whole strings; the best way to reach each place is then folded from left to right and walked back. A
    character without a piece of its own may be unknown, at UNKNOWN_PENALTY below the least score; successive unknowns are one. Words of more
    than ``most`` characters are unknown.
    """
    size = F.length("token")
    longest, least, n = pieces.agg(F.max(F.length("token")), F.min("score"), F.count("*")).first()
    short = spread(distinct.where(size <= most), "token")
    spans = short.select("token", F.explode(F.sequence(F.lit(1), size)).alias("at"))
    spans = spans.select("token", "at", F.explode(F.sequence(F.lit(1), F.least(size - F.col("at") + 1, F.lit(max(1, longest or 1))))).alias("len"))
    spans = spans.withColumn("piece", F.expr("substring(token, at, len)"))
    known = pieces.select(F.col("token").alias("piece"), F.col("token_id").cast("int").alias("id"), F.col("score").cast("double").alias("score"))
    hits = spans.join(lookup_side(known, n), "piece", "left").where("score IS NOT NULL OR len = 1")
    hits = hits.select("token", (F.col("at") + F.col("len") - 1).alias("end"), F.struct("len", F.coalesce("score", F.lit((least or 0.0) - UNKNOWN_PENALTY)).alias("score"), F.coalesce("id", F.lit(unk)).alias("id")).alias("last"))
    ends = hits.groupBy("token", "end").agg(F.collect_list("last").alias("lasts")).groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("end", "lasts"))).alias("places"))
    reach = """
        aggregate(sequence(1, length(token)), array(named_struct('score', 0.0D, 'len', 0, 'id', -1)),
            (s, i) -> concat(s, array(array_max(transform(places[i], c -> named_struct('score', s[i - c.len].score + c.score, 'len', c.len, 'id', c.id))))))
    """
    back = f"""
        aggregate(sequence(1, length(token)), named_struct('at', length(token), 'ids', cast(array() as array<int>)),
            (s, i) -> if(s.at = 0, s, named_struct('at', s.at - best[s.at].len, 'ids', if(best[s.at].id = {unk} and size(s.ids) > 0 and s.ids[0] = {unk}, s.ids, concat(array(best[s.at].id), s.ids)))),
            s -> s.ids)
    """
    folded = ends.where("token <> ''").withColumn("best", F.expr(reach)).select("token", F.expr(back).alias("ids"))
    return distinct.join(folded, "token", "left").select("token", F.coalesce("ids", F.when(size == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(unk)))).alias("ids"))


@cache
def _model(document: str):
    from tokenloom.errors import needed

    return needed("tokenizers", "encoding by a tokenizer document").Tokenizer.from_str(document)


def _ids(document: str, texts: list[str]) -> list[list[int]]:
    model = _model(document)
    batch = getattr(model, "encode_batch_fast", model.encode_batch)
    return [e.ids for e in batch(texts, add_special_tokens=False)]


def encode(docs: DataFrame, document: str, keys: list[str], text: str = "text") -> DataFrame:
    """keys and ids (array of int) of each text by a tokenizer document, without special tokens."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(document)
    rows = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = _ids(shared.value, part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], pa.array(found, pa.list_(pa.int32()))], names=[*keys, "ids"])

    schema = ", ".join([*[f"`{k}` {dict(rows.dtypes)[k]}" for k in keys], "ids array<int>"])
    return rows.mapInArrow(run, schema)


#: Spaces beside which another white space stands: no piece need begin there.
_WIDE = re.compile(r" \s|\s ")
#: Spaces between two other characters than white space.
_LONE = re.compile(r" (?<=\S )(?=\S)")
#: So many distinct pieces are gathered before they are encoded.
PIECES = 200_000


def cut_at_spaces(document: str) -> bool:
    """Whether a document's tokens are those of its texts cut before each lone space: a byte-level BPE that begins a piece there, with
    nothing that looks at more than a piece."""
    doc = json.loads(document)
    model, before = doc.get("model") or {}, doc.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not model.get("dropout") and not any(doc.get(x) for x in ("normalizer", "truncation", "padding"))
    lone = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    added = doc.get("added_tokens") or []
    return bool(plain and lone) and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) for t in added)


def _count_pieces(document: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of texts that are cut before lone spaces: each distinct piece is encoded once for all its occurrences."""
    inner, whole = Counter(), Counter()  # pieces with a space before them, and texts' first pieces

    def encoded() -> pa.RecordBatch:
        found = _ids(document, [*(" " + p for p in inner), *whole])
        times = np.fromiter((n for c in (inner, whole) for n in c.values()), np.int64)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        n = np.zeros(0, np.int64)
        if sizes.any():
            ids = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
            n = np.zeros(int(ids.max()) + 1, np.int64)
            np.add.at(n, ids, np.repeat(times, sizes))
        tokens = np.flatnonzero(n)
        inner.clear()
        whole.clear()
        return pa.RecordBatch.from_arrays([pa.array(tokens.astype(np.int32)), pa.array(n[tokens])], names=["token_id", "n"])

    held = 0  # characters of first pieces
    for batch in batches:
        for text in batch.column(0).to_pylist():
            wide = text[:1] == " " or text[-1:] == " " or _WIDE.search(text)
            first, *rest = _LONE.split(text) if wide else text.split(" ")
            whole[first] += 1
            held += len(first)
            inner.update(rest)
            if len(inner) + len(whole) > PIECES or held > 1 << 23:
                yield encoded()
                held = 0
    if inner or whole:
        yield encoded()


def count_tokens(docs: DataFrame, document: str, weight: float = 1.0, text: str = "text") -> DataFrame:
    """token_id and n, partly summed: each Arrow batch gives a row for each token in it. With a weight, each document's count of
    a token is multiplied and rounded half to even first."""
    shared = docs.sparkSession.sparkContext.broadcast(document)
    by_pieces = weight == 1.0 and cut_at_spaces(document)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if by_pieces:
            yield from _count_pieces(shared.value, batches)
            return
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                found = _ids(shared.value, batch.slice(at, 500).column(0).to_pylist())
                if weight == 1.0:
                    tokens, n = np.unique(np.fromiter((i for ids in found for i in ids), np.int64), return_counts=True)
                else:
                    each = [np.unique(np.array(ids, np.int64), return_counts=True) for ids in found]
                    every = np.concatenate([t for t, _ in each]) if each else np.zeros(0, np.int64)
                    rounded = np.concatenate([np.rint(c * weight) for _, c in each]) if each else np.zeros(0)
                    tokens, where = np.unique(every, return_inverse=True)
                    n = np.bincount(where, rounded, len(tokens)) if len(tokens) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.astype(np.int32)), pa.array(n.astype(np.int64))], names=["token_id", "n"])

    return docs.select(text).mapInArrow(run, "token_id int, n long")


def decode(coded: DataFrame, document: str, keys: list[str]) -> DataFrame:
    """keys and the text of each sequence of ids, special tokens included."""
    shared = coded.sparkSession.sparkContext.broadcast(document)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _model(shared.value).decode_batch([list(x or []) for x in batch.column("ids").to_pylist()], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(texts, pa.string())], names=[*keys, "text"])

    types = dict(coded.dtypes)
    return coded.select(*keys, "ids").mapInArrow(run, ", ".join([*[f"`{k}` {types[k]}" for k in keys], "text string"]))
