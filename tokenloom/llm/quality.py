"""Quality rules: a linear-chain conditional random field marks lines as content or boilerplate.

Each line gets binary features of its bytes (lengths, symbols, capitals, digits, repetition); two
labels form a chain whose transition and feature weights are fitted by likelihood on labelled
documents that the base rule passes, every line of a document of quality 1 being content and of quality 0 boilerplate. As such labels say nothing
of layout, each document also counts with its lines broken after a few words, every other one without its final marks: short
lines or bare ones are then no evidence in themselves. At most
FIT_DOCS documents of each quality, the first by hash, and their first FIT_LINES lines are used to fit; everything
else covers whole texts. Viterbi decoding labels the lines; the share of words in content lines decides. ``held_out`` measures both errors on
documents that a fit on the others hasn't seen.

A null text has no words, so it fails the base rule. Equal rows get equal results. An empty table
gives an empty result. Without labelled rows DEFAULT is used.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.common import NOT_SPACE, byte_table, column_bytes, map_slices, mix, per_row, span_hashes, text_or_empty, window_hashes, word_bounds

FIT_DOCS = 1000
FIT_LINES = 64
LEAST_WORDS = 20
WINDOW = 8
MOST_REPEATED = 30  # per cent of words
LEAST_CONTENT = 0.3
#: Words a line of the broken copies of labelled documents, in turn.
WIDTHS = (3, 5, 7, 9, 12)

SYMBOLS = byte_table(b"#*$%&|<>")
UPPER, LOWER_CASE, DIGITS = byte_table([*range(65, 91)]), byte_table([*range(97, 123)]), byte_table([*range(48, 58)])
LEAD = byte_table([*range(0xC0, 0x100)])
INNER = byte_table([*range(0x80, 0xC0)])
PUNCTUATION = byte_table([b for b in range(33, 127) if not chr(b).isalnum()])
ENDS = byte_table(b".!?")
FEATURES = 21


@dataclass(frozen=True)
class Chain:
    """Scores of two labels, 0 content and 1 boilerplate; the feature weights are those of label 1."""

    weights: tuple[float, ...]
    moves: tuple[tuple[float, float], tuple[float, float]] = ((0.5, -0.5), (-0.5, 0.5))
    first: tuple[float, float] = (0.5, 0.0)


DEFAULT = Chain((-2.0, 0.0, 0.3, 0.0, 0.0, 1.0, 1.5, 2.0, 1.0, 2.0, 0.5, 1.0, 0.0, 1.5, 1.5, 1.5, 0.2, 0.2, 0.5, 1.0, 2.0))


def _sums(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[ends] - total[starts]


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of all rows, and where each row's lines begin; every row has at least one."""
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets[1:], breaks, side="right")
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    rows = np.concatenate([np.arange(len(offsets) - 1), owner])
    order = np.lexsort((np.concatenate([np.full(len(offsets) - 1, -1), breaks]), rows))
    starts = np.concatenate([offsets[:-1], breaks + 1])[order]
    ends = np.empty_like(starts)
    rows = rows[order]
    last = np.ones(len(starts), bool)
    last[:-1] = rows[1:] != rows[:-1]
    ends[:-1] = starts[1:] - 1
    ends[last] = offsets[1:][rows[last]]
    return starts, ends, np.searchsorted(rows, np.arange(len(offsets)))


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each row, and the lines with their features."""
    starts, ends = word_bounds(data, offsets, NOT_SPACE)
    words = per_row(starts, offsets)
    n = len(offsets) - 1
    n_words = np.diff(words)
    solid = NOT_SPACE[data] & ~INNER[data]
    out = {"n_words": n_words, "word_chars": _sums(solid, offsets[:-1], offsets[1:]), "n_symbols": _sums(SYMBOLS[data], offsets[:-1], offsets[1:])}

    of = np.repeat(np.arange(n), n_words)
    hashes = span_hashes(data, starts, ends)
    windows = window_hashes(hashes, WINDOW)
    covered = np.zeros(len(starts) + 1, np.int64)
    if len(windows):
        whole = np.flatnonzero(of[: len(windows)] == of[WINDOW - 1 :])
        own = windows[whole] ^ mix(of[whole].astype(np.uint64) + np.uint64(1))
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        at = whole[order[again]]
        np.add.at(covered, at, 1)
        np.subtract.at(covered, at + WINDOW, 1)
    repeated = np.cumsum(covered[:-1]) > 0
    out["n_repeat_words"] = np.bincount(of[repeated], minlength=n)

    ls, le, line_rows = lines_of(data, offsets)
    line_of = np.repeat(np.arange(n), np.diff(line_rows))
    line_words = np.searchsorted(starts, le) - np.searchsorted(starts, ls)
    own = span_hashes(data, ls, le) ^ mix(line_of.astype(np.uint64) + np.uint64(1))
    used = np.flatnonzero(line_words > 0)
    _, firsts = np.unique(own[used], return_index=True)
    again = np.zeros(len(ls), bool)
    again[used] = True
    again[used[firsts]] = False
    out["n_dup_lines"] = np.bincount(line_of[again], minlength=n)
    echoes = np.zeros(len(starts), bool)
    echoes[1:] = hashes[1:] == hashes[:-1]
    firsts = np.searchsorted(starts, ls)
    echoes[firsts[line_words > 0]] = False
    echo = _sums(echoes, firsts, firsts + line_words)
    out |= {"line_rows": line_rows, "line_words": line_words, "features": _features(data, ls, le, line_words, again, solid, echo)}
    return out


def _features(data, ls, le, words, again, solid, echo) -> np.ndarray:
    count = lambda table: _sums(table[data], ls, le)
    chars = np.maximum(1, _sums(solid, ls, le))
    symbols, upper, digits = count(SYMBOLS), count(UPPER), count(DIGITS)
    letters = np.maximum(1, upper + count(LOWER_CASE) + count(LEAD))
    shout, pipes = _sums(data == 33, ls, le), _sums(data == 124, ls, le)
    mean = chars / np.maximum(1, words)
    tail = np.zeros(len(ls), bool)
    full = le > ls
    tail[full] = ENDS[data[le[full] - 1]]
    columns = [
        np.ones(len(ls), bool), words == 0, (words >= 1) & (words <= 2), (words >= 3) & (words <= 5), words >= 20,
        symbols > 0.02 * chars, symbols > 0.08 * chars, symbols > 0.2 * chars,
        upper > 0.3 * letters, upper > 0.7 * letters, digits > 0.15 * chars, digits > 0.4 * chars,
        tail, shout > 0.05 * chars, pipes > 0.2 * np.maximum(1, words), again,
        (mean > 10) & (words > 0), (mean < 3) & (words > 0), count(PUNCTUATION) > 0.15 * chars,
        echo > 0.1 * words, echo > 0.4 * words,
    ]
    return np.stack(columns, axis=1)


def _padded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by falling number of lines, and how many have a t-th line, for each t."""
    lengths = np.diff(rows)
    order = np.argsort(-lengths, kind="stable")
    falling = lengths[order]
    active = np.searchsorted(-falling, -np.arange(1, (falling[0] if len(falling) else 0) + 1), side="right")
    return order, active


def viterbi(boilerplate: np.ndarray, rows: np.ndarray, chain: Chain) -> np.ndarray:
    """The likeliest labels of all lines; a tie is content. ``boilerplate`` has each line's score for label 1."""
    order, active = _padded(rows)
    begin = rows[:-1][order]
    moves = np.array(chain.moves)
    back = np.zeros((len(boilerplate), 2), np.int8)
    best = np.tile(np.array(chain.first), (len(order), 1))
    if len(order):
        best[:, 1] += boilerplate[begin]
    final = best.copy()
    for t, k in enumerate(active[1:], 1):
        reach = best[:k, :, None] + moves[None]
        choice = reach[:, 1, :] > reach[:, 0, :]
        best = np.where(choice, reach[:, 1, :], reach[:, 0, :])
        at = begin[:k] + t
        best[:, 1] += boilerplate[at]
        back[at] = choice
        final[:k] = best
    labels = np.zeros(len(boilerplate), np.int8)
    if not len(order):
        return labels
    state = (final[:, 1] > final[:, 0]).astype(np.int8)
    lengths = np.diff(rows)[order]
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        ended = lengths[:k] == t + 1
        state[:k][ended] = (final[:k, 1] > final[:k, 0]).astype(np.int8)[ended]
        labels[at] = state[:k]
        if t:
            state[:k] = back[at, state[:k]]
    return labels


def fit(features: np.ndarray, rows: np.ndarray, labels: np.ndarray, rounds: int = 200, ridge: float = 1e-3) -> Chain:
    """Maximum likelihood by gradient steps (Adam), forward and backward passes running over all documents at once."""
    order, active = _padded(rows)
    begin = rows[:-1][order]
    x, y = features.astype(np.float64), labels.astype(np.int64)
    dim = x.shape[1]
    p, m, v = np.zeros(dim + 6), np.zeros(dim + 6), np.zeros(dim + 6)
    docs, total = len(order), max(1, len(y))
    inner = np.ones(len(y), bool)
    inner[rows[:-1]] = False
    seen = np.zeros(dim + 6)
    seen[:dim] = x[y == 1].sum(0)
    np.add.at(seen, dim + 2 * y[np.flatnonzero(inner) - 1] + y[inner], 1)
    np.add.at(seen, dim + 4 + y[rows[:-1]], 1)
    for step in range(1, rounds + 1):
        score, moves, first = x @ p[:dim], p[dim : dim + 4].reshape(2, 2), p[dim + 4 :]
        emit = np.stack([np.zeros(len(y)), score], 1)
        alpha, beta = np.zeros((len(y), 2)), np.zeros((len(y), 2))
        alpha[begin] = first + emit[begin]
        for t, k in enumerate(active[1:], 1):
            a = alpha[begin[:k] + t - 1]
            alpha[begin[:k] + t] = np.logaddexp(a[:, :1] + moves[0], a[:, 1:] + moves[1]) + emit[begin[:k] + t]
        for t in range(len(active) - 1, 0, -1):
            k = active[t]
            b = beta[begin[:k] + t] + emit[begin[:k] + t]
            beta[begin[:k] + t - 1] = np.logaddexp(moves[:, 0] + b[:, :1], moves[:, 1] + b[:, 1:])
        z = np.zeros(docs)
        z[:] = np.logaddexp(*(alpha[begin] + beta[begin]).T)
        line_z = np.empty(len(y))
        line_z[:] = np.repeat(z[np.argsort(order)], np.diff(rows))
        gamma = np.exp(alpha + beta - line_z[:, None])
        hoped = np.zeros(dim + 6)
        hoped[:dim] = x.T @ gamma[:, 1]
        at = np.flatnonzero(inner)
        pair = np.exp(alpha[at - 1][:, :, None] + moves[None] + (emit[at] + beta[at])[:, None, :] - line_z[at][:, None, None])
        hoped[dim : dim + 4] = pair.sum(0).ravel()
        hoped[dim + 4 :] = gamma[rows[:-1]].sum(0)
        slope = (hoped - seen) / total + ridge * p
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    p = np.round(p, 6).tolist()
    return Chain(tuple(p[:dim]), ((p[dim], p[dim + 1]), (p[dim + 2], p[dim + 3])), (p[dim + 4], p[dim + 5]))


def broken(text: str, width: int, bare: bool) -> str:
    """The text with its lines broken after so many words, and perhaps without final marks."""
    out = []
    for line in (re.sub("[.!?]", "", text) if bare else text).split("\n"):
        words = line.split(" ")
        out += [" ".join(words[i : i + width]) for i in range(0, len(words), width)]
    return "\n".join(out)


def _bits(texts: list[bytes]) -> tuple[list[list[int]], np.ndarray]:
    data, offsets = column_bytes(pa.array(texts, pa.binary()))
    found = measures(data, offsets)
    rows, bits = found["line_rows"], (found["features"] << np.arange(FEATURES)).sum(1).astype(np.int64)
    return [bits[a : min(b, a + FIT_LINES)].tolist() for a, b in zip(rows[:-1], rows[1:], strict=True)], base_failed(found)


def _line_bits(batch: pa.RecordBatch) -> pa.RecordBatch:
    raws = batch.column("text").to_pylist()
    own, failed = _bits(raws)
    turn = [zlib.crc32(raw) for raw in raws]
    other, _ = _bits([broken(raw.decode("utf-8", "replace"), WIDTHS[t % len(WIDTHS)], bool(t // len(WIDTHS) % 2)).encode() for raw, t in zip(raws, turn, strict=True)])
    lists = pa.list_(pa.int64())
    whole = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(own, lists), pa.array(other, lists)], names=["doc_id", "quality", "bits", "broken"])
    return whole.filter(pa.array(~failed))


def labelled_lines(docs: DataFrame, labels: DataFrame, per_class: int = FIT_DOCS) -> list[tuple[int, list[int], list[int]]]:
    """(quality, line features, those of the broken copy) of the first ``per_class`` labelled documents of each quality, by hash of doc_id: a bounded
    sample. Of rows with one doc_id the one of the least line features counts, so it doesn't depend on the order of rows."""
    kind = docs.schema["doc_id"].dataType
    parts = [labels.where(F.col("quality") == q).select(F.col("doc_id").try_cast(kind).alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    rows = docs.select("doc_id", text_or_empty(docs).cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    lines = map_slices(rows, _line_bits, T.StructType([T.StructField("doc_id", kind), T.StructField("quality", T.IntegerType()), T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("broken", T.ArrayType(T.LongType()))]))
    found = lines.groupBy("doc_id", "quality").agg(F.min(F.struct("bits", "broken")).alias("of")).collect()  # at most 2 * per_class rows
    found.sort(key=lambda r: (str(r["doc_id"]), r["quality"]))
    return [(r["quality"], r["of"]["bits"], r["of"]["broken"]) for r in found]


def fit_lines(found: list[tuple[int, list[int], list[int]]]) -> Chain:
    if len({q for q, _, _ in found}) < 2:
        return DEFAULT
    each = [(q, x) for q, bits, other in found for x in (bits, other)]
    bits = np.concatenate([np.array(x, np.int64) for _, x in each])
    starts = np.concatenate([[0], np.cumsum([len(x) for _, x in each])])
    label = np.repeat([1 - q for q, _ in each], np.diff(starts))
    return fit((bits[:, None] >> np.arange(FEATURES)) & 1, starts, label)


def fit_on(docs: DataFrame, labels: DataFrame, per_class: int = FIT_DOCS) -> Chain:
    """Fit on a bounded sample of labelled documents."""
    return fit_lines(labelled_lines(docs, labels, per_class))


def held_out(docs: DataFrame, labels: DataFrame, per_class: int = FIT_DOCS) -> dict[str, int]:
    """Fit on every other of the labelled documents and judge the rest by their line labels: how many of quality 1 would go, of how many, and of
    quality 0 stay, of how many. Lines count alike here, as a document's words aren't kept."""
    found = labelled_lines(docs, labels, per_class)
    chain = fit_lines(found[::2])
    bits = [np.array(x, np.int64) for _, x, _ in found[1::2]]
    rows = np.concatenate([[0], np.cumsum([len(x) for x in bits])]).astype(np.int64)
    features = (np.concatenate([*bits, np.zeros(0, np.int64)])[:, None] >> np.arange(FEATURES)) & 1
    labelled = viterbi(features @ np.array(chain.weights), rows, chain)
    kept = np.array([np.mean(labelled[a:b] == 0) >= LEAST_CONTENT for a, b in zip(rows[:-1], rows[1:], strict=True)], bool)
    quality = np.array([q for q, _, _ in found[1::2]], np.int64)
    return {"good_lost": int((~kept & (quality == 1)).sum()), "good": int((quality == 1).sum()), "junk_kept": int((kept & (quality == 0)).sum()), "junk": int((quality == 0).sum())}


def base_failed(found: dict[str, np.ndarray]) -> np.ndarray:
    return (found["n_words"] < LEAST_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED * found["n_words"])


def verdicts(text: pa.Array, chain: Chain) -> dict[str, np.ndarray]:
    data, offsets = column_bytes(text)
    found = measures(data, offsets)
    labels = viterbi(found["features"] @ np.array(chain.weights), found["line_rows"], chain)
    rows = found["line_rows"]
    content = _sums(found["line_words"] * (labels == 0), rows[:-1], rows[1:])
    found["content_share"] = content / np.maximum(1, found["n_words"])
    found["base_failed"] = base_failed(found)
    found["kept"] = ~found["base_failed"] & (found["content_share"] >= LEAST_CONTENT)
    marked = np.flatnonzero(labels)
    cuts = np.searchsorted(marked, rows)
    found["boilerplate"] = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array((marked - np.repeat(rows[:-1], np.diff(cuts))).astype(np.int32)))
    return found


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, the base counts, verdicts, content_share and the numbers (from 0) of boilerplate lines, for every row."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind)]
        + [T.StructField(c, T.LongType()) for c in COUNTS]
        + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("boilerplate", T.ArrayType(T.IntegerType()))]
    )

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        f = verdicts(batch.column("text"), chain)
        columns = [batch.column("doc_id"), *[pa.array(f[c].astype(np.int64)) for c in COUNTS], pa.array(f["base_failed"]), pa.array(f["kept"]), pa.array(f["content_share"]), f["boilerplate"]]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_slices(docs.select("doc_id", text_or_empty(docs).cast("binary").alias("text")), kernel, schema)


def keep(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        last = batch.num_columns - 1
        return batch.filter(pa.array(verdicts(batch.column(last), chain)["kept"])).select(list(range(last)))

    marked = docs.withColumn("__quality_text", text_or_empty(docs).cast("binary"))
    return map_slices(marked, kernel, docs.schema, "__quality_text")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, chain).select("doc_id", *COUNTS, "base_failed", "kept", "content_share")
