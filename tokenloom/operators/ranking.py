"""Ranks and running totals over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenloom.sources.scratch import cut


def ranked(df: DataFrame, order: list[Column], rank: str = "rk", total_of: str | None = None, before: str = "before", total: str = "total") -> DataFrame:
    """Add the 1-based ``rank`` by ``order`` and, with ``total_of``, the sums of that column over all earlier rows (``before``) and over all
    rows (``total``).

    Range partitions are sorted and written once; each one's count and sum, a row a partition, are added up and
    broadcast; ranks within a partition come from the place of a row in it.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    value = F.col(total_of).cast("long") if total_of else F.lit(0).cast("long")
    parts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_count"), F.sum(value).alias("_sum"))
    along = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    parts = parts.select("_part", F.coalesce(F.sum("_count").over(along), zero).alias("_rows"), F.coalesce(F.sum("_sum").over(along), zero).alias("_total"), F.sum("_sum").over(W.partitionBy()).alias("_whole"))
    joined = placed.withColumn("_part", part).join(F.broadcast(parts), "_part")
    joined = joined.withColumn(rank, F.col("_rows") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    if total_of:
        inside = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
        joined = joined.withColumn(before, F.col("_total") + F.coalesce(F.sum(value).over(inside), zero)).withColumn(total, F.col("_whole"))
    return joined.drop("_part", "_rows", "_total", "_whole", "_at")
