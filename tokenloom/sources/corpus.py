"""Corpus readers: files and folders, one text column, limits, samples."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenloom.plans.config import Dataset
from tokenloom.sources.scratch import cut

#: A dataset's loader by file ending, for folders of data files.
ENDINGS = {".json": "json", ".jsonl": "json", ".csv": "csv", ".parquet": "parquet", ".txt": "text", ".arrow": "arrow", ".orc": "orc"}


def _text(reader, files):
    return reader.text(files).withColumnRenamed("value", "text")


LOADERS: dict[str, Callable] = {
    "json": lambda reader, files: reader.json(files),
    "csv": lambda reader, files: reader.option("header", True).option("escape", '"').option("multiLine", True).csv(files),
    "parquet": lambda reader, files: reader.parquet(*files),
    "orc": lambda reader, files: reader.orc(files),
    "text": _text,
}


def _filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, so that any scheme Spark reads can be listed, and the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, at = _filesystem(spark, path)
    return fs.exists(at)


def _is_folder(spark: SparkSession, path: str) -> bool:
    fs, at = _filesystem(spark, path)
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def _listed(spark: SparkSession, folder: str, recursive: bool = True) -> list[str]:
    """The files in a folder, sorted; hidden ones and those of ``_``-folders aren't data."""
    fs, at = _filesystem(spark, folder)
    base = fs.getFileStatus(at).getPath().toString().rstrip("/")
    found, files = [], fs.listFiles(at, recursive)
    while files.hasNext():
        path = files.next().getPath().toString()
        if not any(part.startswith((".", "_")) for part in path[len(base) + 1 :].split("/")):
            found.append(path)
    return sorted(found)


def _folders(spark: SparkSession, folder: str) -> list[str]:
    fs, at = _filesystem(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory())


def _arrow_tables(raw: bytes):
    """Record batches of an Arrow file of either kind, one by one."""
    import pyarrow as pa

    try:
        yield from pa.ipc.open_stream(pa.py_buffer(raw))
    except pa.ArrowInvalid:
        reader = pa.ipc.open_file(pa.py_buffer(raw))
        for i in range(reader.num_record_batches):
            yield reader.get_batch(i)


def _arrow_files(spark: SparkSession, files: list[str], named: bool = False) -> DataFrame:
    """Arrow files, each read by the task that gets it; the first one's head gives the schema. ``named`` adds a row's file as ``_file``."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    if not files:
        raise FileNotFoundError("no Arrow files")
    loaded = spark.read.format("binaryFile").load(files)
    head = loaded.where(F.col("path") == F.lit(loaded.select(F.min("path")).first()[0])).select("content")

    def schema_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                try:
                    own = pa.ipc.open_stream(pa.py_buffer(raw)).schema
                except pa.ArrowInvalid:
                    own = pa.ipc.open_file(pa.py_buffer(raw)).schema
                yield pa.RecordBatch.from_arrays([pa.array([own.remove_metadata().serialize().to_pybytes()], pa.binary())], names=["schema"])

    schema = pa.ipc.read_schema(pa.py_buffer(bytes(head.mapInArrow(schema_of, "schema binary").first()[0])))
    names = schema.names

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for part in _arrow_tables(raw):
                    own = [part.column(n) for n in names]
                    if named:
                        own.append(pa.array([path] * part.num_rows, pa.string()))
                    yield pa.RecordBatch.from_arrays(own, names=[*names, "_file"] if named else names)

    out = from_arrow_schema(schema)
    return loaded.select("path", "content").mapInArrow(rows, out.add("_file", "string") if named else out)


def _arrow(spark: SparkSession, folder: str, split: str, named: bool = False) -> DataFrame:
    """A dataset that was saved as Arrow files: one folder, or one folder a split."""
    names = _folders(spark, folder)
    files = [f for f in _listed(spark, folder, recursive=False)]
    if any(f.endswith("dataset_dict.json") for f in files) or names and not any(f.endswith(".arrow") for f in files):
        if split not in names:
            raise KeyError(f"{folder!r} holds splits {names}, so there is no {split!r} to read")
        files = _listed(spark, f"{folder.rstrip('/')}/{split}", recursive=False)
    return _arrow_files(spark, [f for f in files if f.endswith(".arrow")], named)


SLICE = re.compile(r"^([^\[\]]+)(?:\[(-?\d+%?)?:(-?\d+%?)?\])?$")


def parse_split(split: str) -> list[tuple[str, str | None, str | None]]:
    """Names and bounds of a split expression such as ``train[:1%]`` or ``train[10:20]+test``."""
    out = []
    for part in split.split("+"):
        match = SLICE.match(part.strip())
        if match is None:
            raise ValueError(f"{split!r} is no split")
        out.append(match.groups())
    return out


def placed(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of (loader, table) parts with ``_row``, their number in the order of parts, files by path and places in them, and ``_total``, how
    many there are.

    Spark reads the pieces of files in an order of its own (larger ones first), so a partition's number says nothing of it. Parquet
    knows a row's place in its file; of other files the pieces' places are known, and rows are written once to be numbered
    in them. Only a count a file or piece is gathered.
    """
    out, names = None, []
    for k, (loader, rows) in enumerate(parts):
        own = [c for c in rows.columns if loader != "arrow" or c != "_file"]
        names += [c for c in own if c not in names]
        if loader == "arrow":
            file, block = F.col("_file"), F.lit(0)
        else:
            about = rows.metadataColumn("_metadata")
            file, block = about["file_path"], F.lit(0) if loader == "parquet" else about["file_block_start"]
        at = about["row_index"] if loader == "parquet" else F.monotonically_increasing_id()
        rows = rows.select(*[rows[c] for c in own], F.lit(k).alias("_part"), file.alias("_file"), block.cast("long").alias("_block"), at.alias("_at"))
        rows = rows if loader == "parquet" else cut(rows, "sliced")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    keys = ["_part", "_file", "_block"]
    counts = out.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = counts.select(*keys, (before - F.col("_first")).alias("_before"), F.sum("_n").over(W.partitionBy()).alias("_total"))
    return out.join(F.broadcast(sums), keys).select(*names, (F.col("_before") + F.col("_at")).alias("_row"), "_total")


def take_slice(rows: DataFrame, start: str | None, stop: str | None) -> DataFrame:
    """Of ``placed`` rows those from ``start`` to before ``stop``; percentages are rounded to whole rows, negative bounds count from the end."""
    total = F.col("_total")

    def bound(text: str | None, default):
        if text is None:
            return default
        value = F.round(total * int(text[:-1]) / 100) if text.endswith("%") else F.lit(int(text))
        return F.when(value < 0, total + value).otherwise(value)

    row = F.col("_row")
    return rows.where((row >= bound(start, F.lit(0))) & (row < bound(stop, total))).drop("_row", "_total")


def open_dataset(spark: SparkSession, spec: Dataset) -> DataFrame:
    """The rows of a dataset's split, named by a loader with files, or by a folder on any file system that Spark reads."""
    out, known = None, {}
    for name, start, stop in parse_split(spec.split):
        own = spec.model_copy(update={"split": name})
        if start is None and stop is None:
            rows = _open_split(spark, own)
        else:
            if name not in known:
                known[name] = placed(_parts(spark, own, sliced=True))
            rows = take_slice(known[name], start, stop)
        out = rows if out is None else out.unionByName(rows)
    return out


def _open_split(spark: SparkSession, spec: Dataset) -> DataFrame:
    out = None
    for _, rows in _parts(spark, spec):
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def _parts(spark: SparkSession, spec: Dataset, sliced: bool = False) -> list[tuple[str, DataFrame]]:
    """Loaders and what they read; for slices each given file is a part, in the order given."""
    if spec.load_from_disk:
        return [("arrow", _arrow(spark, spec.path, spec.split, sliced))]
    files = spec.data_files
    if isinstance(files, dict):
        if spec.split not in files:
            raise KeyError(f"no data files for split {spec.split!r}; there are {sorted(files)}")
        files = files[spec.split]
    files = [files] if isinstance(files, str) else files
    if spec.path in LOADERS:
        if files and spec.data_dir:
            files = [f"{spec.data_dir.rstrip('/')}/{f}" for f in files]
        chosen = files or ([spec.data_dir] if spec.data_dir else None)
        if not chosen:
            raise ValueError(f"loader {spec.path!r} needs data_dir or data_files")
        rows = LOADERS[spec.path](spark.read, chosen)
        if not sliced or len(chosen) == 1:
            return [(spec.path, rows)]
        alike = lambda: spark.read if spec.path == "text" else spark.read.schema(rows.schema)
        return [(spec.path, LOADERS[spec.path](alike(), [f])) for f in chosen]
    if not _is_folder(spark, spec.path):
        raise FileNotFoundError(f"{spec.path!r} is neither a loader ({', '.join(sorted(LOADERS))}) nor a folder")
    found: dict[str, list[str]] = {}
    for path in _listed(spark, spec.path):
        if kind := ENDINGS.get(Path(path).suffix):
            found.setdefault(kind, []).append(path)
    if not found:
        raise FileNotFoundError(f"no data files in {spec.path!r}")
    if set(found) == {"arrow"}:
        return [("arrow", _arrow(spark, spec.path, spec.split, sliced))]
    # a folder of several kinds is all of them, by column names
    return [(kind, _arrow_files(spark, paths, sliced) if kind == "arrow" else LOADERS[kind](spark.read, paths)) for kind, paths in sorted(found.items())]


def texts(rows: DataFrame, column: str = "text", limit: int | None = None, order: list | None = None, source: str = "the dataset") -> DataFrame:
    """The non-empty texts of a table as ``text``; the limit counts raw rows, empty ones included."""
    if column not in rows.columns:
        raise KeyError(f"column {column!r} not found in {source!r}; available columns: {sorted(rows.columns)}")
    if limit is not None:
        rows = (rows.orderBy(*order) if order else rows).limit(limit)
    text = F.col(column).cast("string")
    return rows.where(F.col(column).isNotNull() & (text != "")).withColumn("text", text)


def sample(docs: DataFrame, size: int, seed: int = 0, key: str = "text") -> DataFrame:
    """At most ``size`` rows, uniform and the same for a seed however the rows are partitioned: those of the least hashes of the key
    and its number among equal keys, so that equal texts count as often as they stand. (Of one key no more than ``size`` rows
    can be wanted, which bounds what is numbered.)"""
    nth = F.row_number().over(W.partitionBy(key).orderBy(F.lit(0)))
    numbered = docs.withColumn("_nth", nth).where(F.col("_nth") <= size)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col("_nth").cast("string")))
    return numbered.withColumn("_order", order).orderBy("_order", "_nth").limit(size).drop("_order", "_nth")


def read_token_file(path: str | Path) -> list[str]:
    """One token a line; blank lines and lines that begin with # are left out."""
    lines = [line.strip() for line in Path(path).read_text("utf-8").splitlines()]
    return [line for line in lines if line and not line.startswith("#")]


def read_sample_texts(path: str | Path) -> list[str]:
    """One text a line, without blank lines."""
    return [line for line in Path(path).read_text("utf-8").splitlines() if line.strip()]
