"""Tables in the folder that all executors share: lineage cuts that survive a lost executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where none is set and all tasks run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="tokenloom-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write a table to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A lookup table of at most so many rows, some 64 bytes each, may be broadcast.
BROADCAST_ROWS = 1 << 18


def lookup_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A table to be joined to many rows: broadcast if it has few, which is counted, so that frequent keys needn't meet in one task."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def widen(df: DataFrame) -> DataFrame:
    """A table that is read in fewer partitions than there are cores, spread over all of them; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key in as many partitions as the session shuffles to: a table of few bytes may be much work a row, and would otherwise
    be put together in few tasks. Grouping by the keys afterwards moves nothing."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def made() -> int:
    """How many tables this process has written so far."""
    return len(_made)


def clear(spark: SparkSession, since: int) -> None:
    """Delete the tables written after the first ``since``, but for the newest: what was computed from them is in that one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in _made[since:-1]:
        at = hadoop.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    del _made[since:-1]


def cut_counted(df: DataFrame, name: str = "cut", what: Column | None = None) -> tuple[DataFrame, int]:
    """The same, and the number of rows (or another aggregate) as the write itself saw it."""
    seen = Observation()
    table = cut(df.observe(seen, (F.count(F.lit(1)) if what is None else what).alias("n")), name)
    return table, seen.get["n"]
