"""What the corpus operators share: scratch tables, code shipping and byte kernels.

Scratch tables go to the folder the cluster names in ``spark.checkpoint.dir``;
a temporary one is set only where that setting is missing (tests, local runs).
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.sources.scratch import cut, shared_dir

PACKAGE = Path(__file__).resolve().parents[1]
#: Bytes of text that a kernel handles at once; one longer document is handled alone.
SLICE_BYTES = 1 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_tokenloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="tokenloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "tokenloom_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(archive)
    sc._tokenloom_shipped = True


def text_or_empty(docs: DataFrame, text: str = "text"):
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and where each row begins; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of at most ``limit`` bytes of text (or a single longer row)."""
    n = batch.num_rows
    if n == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def map_slices(docs: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema, text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """Apply an Arrow kernel to bounded slices of the table."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, limit):
                yield kernel(part)

    return docs.mapInArrow(run, schema)


def byte_table(members: bytes | list[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Bytes of words between white space (U+0020, U+0009 to U+000D).
NOT_SPACE = ~byte_table([0x20, *range(0x09, 0x0E)])
#: Bytes of words of lower-cased letters, digits and all that isn't ASCII.
ALNUM = byte_table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows; no word crosses from one row to the next."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = table[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][(offsets[:-1] < len(data))]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][(offsets[1:] > 0)] - 1
    last[tails] = inside[tails]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def per_row(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where each row's share of sorted byte positions begins and ends: one longer than the rows."""
    return np.searchsorted(positions, offsets)


_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            for k, r in enumerate((_R, _R_INVERSE)):
                table = np.full(m, r, np.uint64)
                table[0] = 1
                _powers[k] = np.multiply.accumulate(table)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (splitmix64's finish)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    power, inverse = _power_tables(len(data) + 1)[:2]
    prefix = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=prefix[1:])
        value = (prefix[ends] - prefix[starts]) * inverse[starts]
        return mix(value ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k successive values; shorter by k - 1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = mix((out ^ words[j : j + n]) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(j + 1))
    return out


#: A key with more than one in so many of all rows is hot; there are fewer than so many, so these can be broadcast.
HOT_SHARE = 1000


def split_join(rows: DataFrame, side: DataFrame, on: list[str], weight: str, share: int = HOT_SHARE) -> DataFrame:
    """Inner join with a written ``side`` of distinct keys, whose ``weight`` says how many rows each has. The hot ones, fewer than ``share``,
    are broadcast, so that none of their rows is moved; the others are joined by shuffle."""
    total = side.agg(F.sum(weight)).first()[0] or 0
    hot, cold = side.where(F.col(weight) * share > total), side.where(F.col(weight) * share <= total)
    near = rows.join(F.broadcast(hot), on)
    far = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return near.unionByName(far)


def streamed(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of rows with equal keys from batches sorted by them."""
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        values = batch[keys].to_numpy()
        edges = np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1
        for a, b in zip([0, *edges], [*edges, len(batch)], strict=True):
            key = tuple(values[a])
            if held and key != last:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(batch.iloc[a:b])
            last = key
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]
