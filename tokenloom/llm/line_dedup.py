"""Line dedup over content-defined chunks of lines and passages of over PASSAGE_WORDS words.

A rolling hash over the hashes of ROLL successive lines ends a chunk where it is divisible by DIVISOR, so boundaries
depend on the lines next to them alone and come back after insertions; a chunk has 2 to 16
lines. Of chunks with at least two lines of words that occur more than once in the whole corpus, all but the
first are removed. Besides, wherever chunks end, a line is removed that lies in successive lines of over
PASSAGE_WORDS words together which occur earlier as well; a single line can be enough. That is
exact: the shortest such runs from each line on and up to each line cover every longer one. Blank lines between two removed
lines go too. Runs are found by 64-bit hashes, which say what may be repeated at all; then those
are compared by SHA-256 of their whole bytes.

First means smallest doc_id (null last), then hash of the row, then position. Null texts are empty and lose
nothing. Rows equal in doc_id and text count as one document and get the same result. Single lines of at most
PASSAGE_WORDS words are never removed on their own. An empty table gives an empty result; other columns are left as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.common import NOT_SPACE, column_bytes, cut, map_slices, mix, span_hashes, split_join, text_or_empty, word_bounds
from tokenloom.llm.quality import lines_of

#: Lines that the rolling hash spans, and its base: each step multiplies by the base and adds a line's hash.
ROLL, BASE = 2, np.uint64(0xC2B2AE3D27D4EB4F)
DIVISOR = 3
LEAST_LINES, MOST_LINES = 2, 16
#: Repeated successive lines of more words than that are a passage.
PASSAGE_WORDS = 50


class Chunks:
    """The chunks of all rows: byte spans, hashes, lines, whether they may be removed, and where each row's begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        ls, le, rows = lines_of(data, offsets)
        hashes = span_hashes(data, ls, le)
        rolled = np.zeros(len(hashes), np.uint64)
        with np.errstate(over="ignore"):
            for back in range(min(ROLL, len(hashes)) - 1, -1, -1):
                rolled *= BASE
                rolled[back:] += hashes[: len(hashes) - back]
        ends_here = mix(rolled) % np.uint64(DIVISOR) == 0
        firsts, counts = [], []
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            begin, before = a, len(firsts)
            firsts.append(a)
            for i in (np.flatnonzero(ends_here[a + ROLL - 1 : b]) + a + ROLL - 1).tolist():
                while i - begin >= MOST_LINES:
                    begin += MOST_LINES
                    firsts.append(begin)
                if i - begin + 1 >= LEAST_LINES and i + 1 < b:
                    begin = i + 1
                    firsts.append(begin)
            while b - begin > MOST_LINES:
                begin += MOST_LINES
                firsts.append(begin)
            counts.append(len(firsts) - before)
        first = np.array(firsts, np.int64)
        self.rows = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        owner = np.repeat(np.arange(len(offsets) - 1), counts)
        last = np.append(first[1:], len(ls)) - 1
        self.lines = last - first + 1
        self.starts = ls[first]
        # A chunk takes its last line's break along, if the row goes on.
        self.ends = np.minimum(le[last] + 1, offsets[1:][owner])
        self.hashes = span_hashes(data, self.starts, le[last])
        self.body_ends = le[last]
        starts, _ = word_bounds(data, offsets, NOT_SPACE)
        self.words = np.searchsorted(starts, le) - np.searchsorted(starts, ls)
        total = np.concatenate([[0], np.cumsum(self.words > 0)])
        self.several = (self.lines >= 2) & (total[last + 1] - total[first] >= 2)
        self.first, self.last = first, last
        self.line_starts, self.line_ends, self.line_rows = ls, le, rows


class Spans:
    """The runs of lines of which copies go, by first and last line, in order: chunks with several lines of words and, for ``passages``, the
    shortest runs of over PASSAGE_WORDS words from each line of words on and up to each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, passages: bool) -> None:
        self.chunks = c = Chunks(data, offsets)
        self.passages = passages
        first, last = [c.first[c.several]], [c.last[c.several]]
        if passages:
            total = np.concatenate([[0], np.cumsum(c.words)])
            line = np.flatnonzero(c.words)
            row = np.searchsorted(c.line_rows, line, side="right") - 1
            to = np.searchsorted(total, total[line] + PASSAGE_WORDS + 1) - 1
            since = np.searchsorted(total, total[line + 1] - PASSAGE_WORDS - 1, side="right") - 1
            ahead, behind = to < c.line_rows[row + 1], since >= c.line_rows[row]
            first += [line[ahead], since[behind]]
            last += [to[ahead], line[behind]]
        n = len(c.words) + 1
        self.first, self.last = np.divmod(np.unique(np.concatenate(first) * n + np.concatenate(last)), n)
        self.rows = np.searchsorted(self.first, c.line_rows)
        self.starts, self.ends = c.line_starts[self.first], c.line_ends[self.last]
        self.hashes = span_hashes(data, self.starts, self.ends)

    def picked(self, batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
        """Each row's spans of those numbered in a column."""
        lists = batch.column(column)
        out = []
        for i in range(batch.num_rows):
            x = lists[i].values
            out.append(np.zeros(0, np.int64) if x is None else np.unique(x.to_numpy(zero_copy_only=False)) + self.rows[i])
        return out

    def lines_in(self, at: np.ndarray) -> np.ndarray:
        """Whether each line lies in one of the spans or, for passages, is blank and between two such lines."""
        c = self.chunks
        n = len(c.words)
        gone = np.cumsum(np.bincount(self.first[at], minlength=n + 1) - np.bincount(self.last[at] + 1, minlength=n + 1))[:n] > 0
        if not self.passages:
            return gone
        solid = np.flatnonzero((c.words > 0) | gone)
        before = np.searchsorted(solid, np.arange(n)) - 1
        row = np.repeat(np.arange(len(c.line_rows) - 1), np.diff(c.line_rows))
        blank = np.flatnonzero((c.words == 0) & ~gone)
        blank = blank[(before[blank] >= 0) & (before[blank] + 1 < len(solid))]
        left, right = solid[before[blank]], solid[before[blank] + 1]
        gone[blank[gone[left] & gone[right] & (row[left] == row[blank]) & (row[right] == row[blank])]] = True
        return gone


def repeated_spans(docs: DataFrame, passages: bool) -> DataFrame:
    """doc_id, row_hash and the numbers of the spans to remove, for each document that loses any."""
    text = text_or_empty(docs)
    kind = docs.schema["doc_id"].dataType
    key = [T.StructField("doc_id", kind), T.StructField("row_hash", T.LongType())]
    rows = docs.select(docs["doc_id"], F.xxhash64(docs["doc_id"], text).alias("row_hash"), text.cast("binary").alias("text"))

    def hash_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = Spans(*column_bytes(batch.column("text")), passages)
        hashes = pa.ListArray.from_arrays(pa.array(s.rows.astype(np.int32)), pa.array(s.hashes.view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_hash"), hashes], names=["doc_id", "row_hash", "hashes"])

    def digest_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = column_bytes(batch.column("text"))
        s = Spans(data, offsets, passages)
        picked = s.picked(batch, "wanted")
        of = np.repeat(np.arange(batch.num_rows), [len(p) for p in picked])
        at = np.concatenate(picked) if picked else np.zeros(0, np.int64)
        raw = memoryview(data.tobytes())
        digests = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(s.starts[at].tolist(), s.ends[at].tolist(), strict=True)]
        take = pa.array(of)
        no = pa.array((at - s.rows[:-1][of]).astype(np.int32))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("row_hash").take(take), no, pa.array(digests, pa.binary())], names=["doc_id", "row_hash", "span", "digest"])

    slim = cut(map_slices(rows, hash_batch, T.StructType([*key, T.StructField("hashes", T.ArrayType(T.LongType()))])), "spans")
    each = slim.select("doc_id", "row_hash", F.posexplode("hashes").alias("span", "hash"))
    often = cut(each.groupBy("hash").agg(F.count("*").alias("times")).where("times > 1"), "often")
    wanted = split_join(each, often, ["hash"], "times").groupBy("doc_id", "row_hash").agg(F.collect_list("span").alias("wanted"))
    wanted = wanted.select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), "wanted")
    picked = rows.join(wanted, F.expr("row_hash = _hash AND doc_id <=> _id")).select("doc_id", "row_hash", "wanted", "text")
    schema = T.StructType([*key, T.StructField("span", T.IntegerType()), T.StructField("digest", T.BinaryType())])
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash", "span")
    seen = cut(map_slices(picked, digest_batch, schema), "digests")
    groups = cut(seen.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1"), "repeats")
    found = split_join(seen, groups, ["digest"], "times")
    return found.where(place != F.col("first")).groupBy("doc_id", "row_hash").agg(F.collect_set("span").alias("removed"))


def remove_repeats(docs: DataFrame, passages: bool = False) -> DataFrame:
    """All rows of ``docs`` with the repeated chunks, and for ``passages`` all lines of repeated passages, cut out of their text, and
    what was cut: lines, chunks, chunks of which nothing is left and removed lines as ``line_dedup``."""
    removed = repeated_spans(docs, passages).select(F.col("doc_id").alias("__line_id"), F.col("row_hash").alias("__line_of"), F.col("removed").alias("__line_removed"))
    rows = docs.withColumn("__line_hash", F.xxhash64(docs["doc_id"], text_or_empty(docs)))
    joined = rows.join(removed, F.expr("__line_hash = __line_of AND doc_id <=> __line_id"), "left")
    at = docs.columns.index("text")
    joined = joined.select(*[docs[c] for c in docs.columns], "__line_removed").withColumn("__line_text", docs["text"].cast("binary"))
    stats = T.StructType([T.StructField(c, T.LongType()) for c in ("lines", "chunks", "removed_chunks", "removed_lines")])
    fields = list(docs.schema.fields)
    fields[at] = T.StructField("text", T.StringType())
    schema = T.StructType([*fields, T.StructField("line_dedup", stats)])

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = column_bytes(batch.column("__line_text"))
        s = Spans(data, offsets, passages)
        c = s.chunks
        picked = s.picked(batch, "__line_removed")
        gone = s.lines_in(np.concatenate(picked))
        lost = np.concatenate([[0], np.cumsum(gone)])
        whole = np.concatenate([[0], np.cumsum(lost[c.last + 1] - lost[c.first] == c.lines)])
        raw = data.tobytes()
        out = []
        given = batch.column("__line_text")
        for i, spans in enumerate(picked):
            if not len(spans):
                out.append(raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace") if given[i].is_valid else None)
                continue
            a, b = c.line_rows[i : i + 2]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]))) + a
            parts, at_byte = [], int(offsets[i])
            for first, end in edges.reshape(-1, 2).tolist():
                parts.append(raw[at_byte : c.line_starts[first]])
                at_byte = min(int(c.line_ends[end - 1]) + 1, int(offsets[i + 1]))  # with the last line's break, if the row goes on
            parts.append(raw[at_byte : offsets[i + 1]])
            out.append(b"".join(parts).decode("utf-8", "replace"))
        columns = [batch.column(i) for i in range(len(fields))]
        columns[at] = pa.array(out, pa.string())
        numbers = [np.diff(c.line_rows), np.diff(c.rows), np.diff(whole[c.rows]), np.diff(lost[c.line_rows])]
        columns.append(pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in numbers], names=stats.names))
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_slices(joined, kernel, schema, "__line_text")


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, passages=True).select("doc_id", "line_dedup.lines", "line_dedup.chunks", "line_dedup.removed_chunks", "line_dedup.removed_lines", "text")
