"""Token ids as wavelet matrices, one compressed file a shard.

A file holds the ids of consecutive documents as bit-planes, from the highest bit down; each plane puts the
ids whose bit is 0 before those whose bit is 1. With counts of ones before every 512 bits, one
file answers which token stands at a place (access), how often a token occurs in a range (count) and where (locate),
without being decoded. Planes are compressed in blocks that are read alone.

Documents are range-partitioned and sorted by doc_id (null first, ties by hash of the text), encoded, given an end id
and written by the task that holds them; a file appears under its final name only when whole, so a task that
runs again replaces it by the same. Where a document starts among all ids follows from the files' token
counts, one row a file. A null text is an empty one: its end id alone. An empty table writes no file. Files keep
doc_ids as 64-bit whole numbers; others are an error.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import compress
from operator import not_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.common import LOWER, NOT_SPACE, byte_table, column_bytes, cut, scratch_path, ship, slices, span_hashes, text_or_empty, word_bounds

MAGIC = b"WAVELET1"
BLOCK = 1 << 16  # bytes of a plane that are compressed together
RANK = 512  # bits between stored counts
SHARD_TOKENS = 1 << 24
SLICE = 1 << 21  # bytes of text whose words are looked up together
TOGETHER = 500  # words of letters that are encoded as one text
CACHE = 1_000_000  # words that a worker keeps, some 200 bytes each
END = 2


def build(ids: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[int]]:
    """Packed planes from the highest bit down, and the number of zeros of each."""
    planes, zeros = [], []
    for b in range(bits - 1, -1, -1):
        one = (ids >> b & 1).astype(bool)
        planes.append(np.packbits(one))
        low = ids[~one]
        zeros.append(len(low))
        ids = np.concatenate([low, ids[one]])
    return planes, zeros


def write(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A shard's file: documents, their numbers of ids, and all ids one after another."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    ids = ids.astype(np.uint16) if bits <= 16 else ids
    planes, zeros = build(ids, bits)
    press = zstandard.ZstdCompressor(level=1)
    body: list[bytes] = []
    at = 0

    def put(raw: bytes) -> tuple[int, int]:
        nonlocal at
        body.append(press.compress(raw))
        at += len(body[-1])
        return at - len(body[-1]), len(body[-1])

    head: dict = {"tokens": len(ids), "bits": bits, "zeros": zeros, "documents": len(doc_ids)}
    head["doc_ids"] = put(np.array([x or 0 for x in doc_ids], "<i8").tobytes())
    head["nulls"] = put(np.array([x is None for x in doc_ids], np.uint8).tobytes())
    head["lengths"] = put(np.array(lengths, "<i8").tobytes())
    head["planes"], head["ranks"] = [], []
    for plane in planes:
        raw = plane.tobytes()
        head["planes"].append([put(raw[i : i + BLOCK]) for i in range(0, len(raw), BLOCK)])
        ones = np.bitwise_count(plane).astype(np.int64)
        ones = np.add.reduceat(ones, np.arange(0, len(ones), RANK // 8)) if len(ones) else ones
        head["ranks"].append(put(np.concatenate([[0], np.cumsum(ones)]).astype("<u4").tobytes()))
    header = json.dumps(head).encode()
    return b"".join([MAGIC, len(header).to_bytes(8, "little"), header, *body])


class Shard:
    """A file's contents; planes are decompressed block by block as they are asked for."""

    def __init__(self, raw: bytes) -> None:
        if raw[:8] != MAGIC:
            raise ValueError("not a wavelet file")
        size = int.from_bytes(raw[8:16], "little")
        self.head = json.loads(raw[16 : 16 + size])
        self.raw = memoryview(raw)[16 + size :]
        self.open = zstandard.ZstdDecompressor()
        self.tokens, self.bits, self.zeros = self.head["tokens"], self.head["bits"], self.head["zeros"]
        nulls = self._array("nulls", np.uint8)
        self.doc_ids = [None if n else int(x) for x, n in zip(self._array("doc_ids", "<i8"), nulls, strict=True)]
        self.lengths = self._array("lengths", "<i8")
        self.blocks: dict[tuple[int, int], np.ndarray] = {}
        self.ranks: dict[int, np.ndarray] = {}

    def _get(self, place: list[int]) -> bytes:
        return self.open.decompress(self.raw[place[0] : place[0] + place[1]])

    def _array(self, name: str, kind) -> np.ndarray:
        return np.frombuffer(self._get(self.head[name]), kind)

    def _bytes(self, level: int, a: int, b: int) -> np.ndarray:
        parts = []
        for k in range(a // BLOCK, (max(a, b - 1)) // BLOCK + 1):
            if k >= len(self.head["planes"][level]):
                break
            if (level, k) not in self.blocks:
                self.blocks[level, k] = np.frombuffer(self._get(self.head["planes"][level][k]), np.uint8)
            parts.append(self.blocks[level, k][max(0, a - k * BLOCK) : b - k * BLOCK])
        return np.concatenate(parts) if parts else np.zeros(0, np.uint8)

    def _ones(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        if level not in self.ranks:
            self.ranks[level] = np.frombuffer(self._get(self.head["ranks"][level]), "<u4")
        k = i // RANK
        rest = self._bytes(level, k * RANK // 8, (i + 7) // 8) if i % RANK else np.zeros(0, np.uint8)
        return int(self.ranks[level][k]) + int(np.unpackbits(rest)[: i - k * RANK].sum())

    def _bit(self, level: int, i: int) -> int:
        return int(self._bytes(level, i // 8, i // 8 + 1)[0]) >> (7 - i % 8) & 1

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            x, y = self._ones(level, a), self._ones(level, b)
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if token >> (self.bits - 1 - level) & 1 else (a - x, b - y)
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """Occurrences of a token from place a to before b."""
        x, y = self._range(token, a, self.tokens if b is None else b)
        return y - x

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane."""
        low, high = 0, self.tokens
        while high - low > 1:
            mid = (low + high) // 2
            before = self._ones(level, mid)
            if (before if bit else mid - before) <= k:
                low = mid
            else:
                high = mid
        return low

    def locate(self, token: int, k: int) -> int:
        """Place of a token's k-th occurrence, from 0."""
        a, b = self._range(token, 0, self.tokens)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids, undoing one plane after another from the lowest bit."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        ids = np.zeros(self.tokens, kind)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self._bytes(level, 0, (self.tokens + 7) // 8), count=self.tokens).astype(bool)
            up = np.empty_like(ids)
            up[~one] = ids[: self.zeros[level]]
            up[one] = ids[self.zeros[level] :] | kind(1 << (self.bits - 1 - level))
            ids = up
        return ids


def apart(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with A-Z lower-cased and blanks put between rows and wherever a letter of ASCII or Latin-1 meets ASCII
    punctuation other than an apostrophe, and where the rows then begin. No token crosses such a place."""
    data = LOWER[data]
    n = len(data)
    letter = _LETTER[data]
    if n > 1:
        pair = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    else:
        pair = np.zeros(0, bool)
    ends, begins = letter.copy(), letter
    ends[1:] |= pair
    begins[:-1] |= pair
    mark = _MARK[data]
    here = np.zeros(n + 1, bool)
    here[1:-1] = ends[:-1] & mark[1:] | mark[:-1] & begins[1:] if n else False
    here[offsets] = True
    here[0] = here[n] = False
    cuts = np.flatnonzero(here)
    return np.insert(data, cuts, 0x20), offsets + np.searchsorted(cuts, offsets)


_LETTER = byte_table([*range(97, 123)])
_MARK = byte_table([b for b in range(33, 127) if not chr(b).isalnum() and b != 39])


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's number among the distinct ones, and where these stand first. Words are told apart by hash, and by their length and
    first and last eight bytes; should words of one hash differ in these, all are compared by their bytes."""
    codes, distinct = pd.factorize(span_hashes(data, starts, ends))
    first = np.empty(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 8, "<u8", padded, 0, (1,))
    size = ends - starts
    keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.minimum(size, 8)).astype(np.uint64))
    for value in (size, eight[starts + 8] & keep, eight[ends] >> (np.uint64(8) * (8 - np.minimum(size, 8)).astype(np.uint64))):
        if (value != value[first][codes]).any():
            raw = data.tobytes()
            codes, _ = pd.factorize(np.array([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)] + [None], object)[:-1])
            first = np.empty(codes.max(initial=-1) + 1, np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            return codes, first
    return codes, first


class Words:
    """The tokenizer over words, which none of its tokens crosses; known words are kept. A text with one of the tokenizer's added
    tokens in it is encoded whole, so that this becomes its id as in a plain call."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.letters = Tokenizer.from_file(path)
        self.letters.encode_special_tokens = True
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.model = Tokenizer.from_file(path)
        self.added = [t.content.encode().lower() for t in self.model.get_added_tokens_decoder().values()]
        self.model.encode_special_tokens = True
        self.known: dict[bytes, bytes] = {}
        self.final = np.array([t.endswith("</w>") for t, _ in sorted(self.model.get_vocab().items(), key=lambda x: x[1])])

    def learn(self, words: list[bytes]) -> None:
        """Words of letters alone are one unit of the tokenizer each, so they are encoded together and cut at the tokens that end
        a unit; if these aren't as many as the words, and for all other words, each is encoded by itself. Those of lower-cased ASCII letters
        need neither normalising nor the tokenizer's own splitting."""
        simple, plain, rest = [], [], []
        for w in words:
            (simple if w.isalpha() else plain if w.decode("utf-8", "replace").isalpha() else rest).append(w)
        for model, group in ((self.letters, simple), (self.model, plain)):
            parts = [group[at : at + TOGETHER] for at in range(0, len(group), TOGETHER)]
            for part, found in zip(parts, model.encode_batch_fast([b" ".join(p).decode("utf-8", "replace") for p in parts], add_special_tokens=False) if parts else [], strict=True):
                ids = np.array(found.ids, "<u4")
                ends = np.flatnonzero(self.final[ids]) + 1
                if len(ends) != len(part):
                    rest += part
                    continue
                raw = ids.tobytes()
                before = 0
                for word, end in zip(part, (4 * ends).tolist(), strict=True):
                    self.known[word] = raw[before:end]
                    before = end
        for at in range(0, len(rest), 5000):
            part = rest[at : at + 5000]
            for word, found in zip(part, self.model.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False), strict=True):
                self.known[word] = np.array(found.ids, "<u4").tobytes()

    def with_added(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """The rows that have an added token in them, in any case."""
        raw, found = LOWER[data].tobytes(), set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + len(token) <= offsets[row + 1]:
                    found.add(row)
                    at = raw.find(token, int(offsets[row + 1]))
                else:
                    at = raw.find(token, at + 1)
        return sorted(found)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids one after another, and the number of each row's."""
        ids, counts = self.encode_words(data, offsets)
        whole = self.with_added(data, offsets)
        if not whole:
            return ids, counts
        parts = np.split(ids, np.cumsum(counts)[:-1])
        self.model.encode_special_tokens = False
        for row in whole:
            text = data[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8", "replace")
            parts[row] = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        self.model.encode_special_tokens = True
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def encode_words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode, with added tokens as plain text."""
        data, offsets = apart(data, offsets)
        starts, ends = word_bounds(data, offsets, NOT_SPACE)
        of, first = distinct_words(data, starts, ends)
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        found = list(map(self.known.get, words))
        missing = list(compress(range(len(found)), map(not_, found)))  # unknown ones, and the rare ones without any id
        if missing:
            if len(self.known) > CACHE:
                self.known = {}
            self.learn([words[i] for i in missing])
            for i in missing:
                found[i] = self.known[words[i]]
        ids = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin, n = (np.cumsum(size) - size)[of], size[of]
        total = np.concatenate([[0], np.cumsum(n)])
        kind = np.int32 if total[-1] < 1 << 31 else np.int64
        place = np.repeat((begin - total[:-1]).astype(kind), n)
        place += np.arange(total[-1], dtype=kind)
        return ids.take(place), np.diff(total[np.searchsorted(starts, offsets)])


_words: dict[str, Words] = {}


def words(path: str) -> Words:
    """This process's tokenizer for a vocabulary."""
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def _filesystem(path: str):
    """Arrow's file system of a path; it names S3 by one scheme, Spark by three."""
    for scheme in ("s3a://", "s3n://"):
        path = path.replace(scheme, "s3://", 1) if path.startswith(scheme) else path
    return pa.fs.FileSystem.from_uri(path)


def _save(path: str, raw: bytes) -> None:
    fs, at = _filesystem(path)
    partial = f"{at}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(partial) as f:
        f.write(raw)
    fs.move(partial, at)


def write_shards(docs: DataFrame, vocabulary: str, folder: str, end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the files; return one row for each: part, number, path, documents, tokens and start (ids of all files before)."""
    spark = docs.sparkSession
    ship(spark)
    text = text_or_empty(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.cast("binary").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    local, at = _filesystem(folder)
    local.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = words(vocabulary)
        part, number = TaskContext.get().partitionId(), 0
        ids, lengths, coded, tokens = [], [], [], 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/{part:06d}-{number:06d}.wm"
            _save(path, write(ids, lengths, np.concatenate(coded)))
            return pa.RecordBatch.from_pylist([{"part": part, "number": number, "path": path, "documents": len(ids), "tokens": tokens}], pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]))

        for batch in batches:
            for some in slices(batch, limit=SLICE):
                found, counts = model.encode(*column_bytes(some.column("text")))
                coded.append(np.insert(found, np.cumsum(counts), end))
                ids += some.column("doc_id").to_pylist()
                lengths += (counts + 1).tolist()
                tokens += len(coded[-1])
                if tokens >= shard_tokens:
                    yield flush()
                    number += 1
                    ids, lengths, coded, tokens = [], [], [], 0
        if ids:
            yield flush()

    files = cut(placed.select("doc_id", "text").mapInArrow(run, "part int, number int, path string, documents long, tokens long"), "manifest")
    before = F.sum("tokens").over(W.orderBy("part", "number").rowsBetween(W.unboundedPreceding, -1))
    return files.withColumn("start", F.coalesce(before, F.lit(0)))


def read_shards(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    ship(files.sparkSession)
    tasks = tasks or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, at = _filesystem(path)
                with fs.open_input_stream(at) as f:
                    shard = Shard(f.read())
                ids = memoryview(shard.decode().astype("<u4").tobytes())
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(starts + start), pa.array(shard.lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=schema.names)

    return files.select("path", "start").repartition(tasks, "path").mapInArrow(run, schema)


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_wavelet_ids(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_shards(write_shards(docs, public_vocabulary(), scratch_path(spark, "wavelet")))
