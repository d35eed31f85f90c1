"""Exact deduplication over an extendible-hash index on shared files; DataFrame and SQL functions only.

The index key is a 64-bit hash of the text. A directory maps the key's leading bits to buckets: it begins with as many
bits as the number of keys asks for, any bucket that holds more distinct keys than its capacity is split by one
more bit, and the directory doubles to the deepest bucket's bits, several of its slots pointing to a shallower one. A bucket is a range
of keys and has one owner task. Whole texts are sent to their buckets' owners, which compare them byte by byte,
put equal ones together and chain different ones of one key; copies of hot texts are collapsed before they are sent.
Entries are written by bucket, key and chain. Every row then probes the index: its key's slot in the directory, the bucket, the key in it, and the
entry of the chain with the row's digest.

A null text is an empty one. Of equal texts the row with the largest doc_id stays; null doc_ids
lose to all others, and of rows that also agree in doc_id exactly one stays. An empty table gives an
empty result, extra columns don't matter. ``extend`` adds documents to a written index.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenloom.llm.common import HOT_SHARE, cut, split_join, text_or_empty

CAPACITY = 128
#: A bucket may be split so many times below the directory's first bits, which suit the number of keys; a 64-bit hash of that
#: many keys never needs as many. A bucket that did would keep all its entries (an overflow chain).
SPLITS, MOST_BITS = 8, 48
#: A directory of at most so many slots (16 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_SLOTS = 1 << 18


@dataclass
class Directory:
    """slots: slot (the key's leading ``bits``), bucket and its local depth."""

    slots: DataFrame
    bits: int
    small: bool

    def find(self, rows: DataFrame) -> DataFrame:
        """Rows with their key's bucket and its depth."""
        slots = F.broadcast(self.slots) if self.small else self.slots
        return rows.withColumn("slot", F.shiftrightunsigned("key", 64 - self.bits)).join(slots, "slot").drop("slot")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> Directory:
    """Split overfull buckets of distinct keys."""
    n = keys.count()
    least = min(MOST_BITS - SPLITS, max(0, math.ceil(math.log2(max(1, n) / capacity))))
    most = least + SPLITS
    fine = keys.groupBy(F.shiftrightunsigned("key", 64 - most).alias("slot")).agg(F.count("*").alias("n"))
    levels = fine.select("slot", "n", F.explode(F.sequence(F.lit(least), F.lit(most))).alias("depth"))
    levels = levels.groupBy("depth", F.expr(f"shiftright(slot, {most} - depth)").alias("prefix")).agg((F.sum("n") > capacity).alias("full"))
    levels = cut(levels, "buckets")
    split = levels.where("full").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
    kept = levels.where(f"NOT full OR depth = {most}").withColumn("above", F.shiftright("prefix", 1))
    buckets = kept.where(F.col("depth") == least).unionByName(kept.where(F.col("depth") > least).join(split, ["depth", "above"], "left_semi"))
    bits = max(1, buckets.agg(F.max("depth")).first()[0] or 0)
    first = F.expr(f"shiftleft(prefix, {bits} - depth)")
    slots = buckets.select(
        F.explode(F.sequence(first, first + F.expr(f"shiftleft(1L, {bits} - depth)") - 1)).alias("slot"),
        F.expr(f"shiftleft(prefix, {most} - depth)").alias("bucket"), "depth",
    )
    slots = cut(slots, "directory")
    return Directory(slots, bits, slots.count() <= BROADCAST_SLOTS)


def keys(docs: DataFrame) -> DataFrame:
    """One slim row for each document: doc_id, key, digest and a number of its own (stable once written)."""
    text = text_or_empty(docs)
    return docs.select(docs["doc_id"], F.xxhash64(text).alias("key"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), F.monotonically_increasing_id().alias("_row"))


def build_index(docs: DataFrame, slim: DataFrame, capacity: int = CAPACITY, earlier: DataFrame | None = None) -> tuple[Directory, DataFrame]:
    """The directory and the written index: bucket, depth, key, chain, text_sha256, keep_id, group_size; a row for each distinct text.
    Entries of an ``earlier`` index are taken over; a new text is one of them if key and digest agree."""
    counts = cut(slim.groupBy("key").agg(F.count("*").alias("rows")), "key-counts")
    every = counts.select("key")
    if earlier is not None:
        every = every.union(earlier.select("key")).distinct()
    known = directory(every, capacity)
    total = counts.agg(F.sum("rows")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("rows") * HOT_SHARE > total).select("key"))
    text = text_or_empty(docs)
    rows = known.find(docs.select(docs["doc_id"].alias("keep_id"), text.alias("text"), F.xxhash64(text).alias("key")))
    whole = ["bucket", "depth", "key", "text"]
    many = rows.join(hot, "key", "left_semi").groupBy(*whole).agg(F.max("keep_id").alias("keep_id"), F.count("*").alias("group_size"))
    few = rows.join(hot, "key", "left_anti").withColumn("group_size", F.lit(1).cast("long"))
    owned = few.unionByName(many).repartition("bucket").groupBy(*whole).agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    entries = owned.select("bucket", "depth", "key", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    if earlier is not None:
        old = known.find(earlier.select("key", "text_sha256", "keep_id", "group_size"))
        both = entries.unionByName(old).repartition("bucket").groupBy("bucket", "depth", "key", "text_sha256")
        entries = both.agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    chain = F.row_number().over(W.partitionBy("bucket", "key").orderBy("text_sha256")) - 1
    return known, cut(entries.withColumn("chain", chain).sortWithinPartitions("bucket", "key", "chain"), "hash-index")


def probe(slim: DataFrame, known: Directory, index: DataFrame) -> DataFrame:
    """Each row with its entry, by way of directory, bucket, key and chain. Hot entries, of which there are fewer than HOT_SHARE, are
    broadcast; the rest shuffles."""
    return split_join(known.find(slim).drop("depth"), index, ["bucket", "key", "text_sha256"], "group_size")


def group_copies(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Return doc_id, keep_id, group_size, kept, text_sha256, key, bucket, depth and chain for every row."""
    slim = cut(keys(docs), "keys")
    found = cut(probe(slim, *build_index(docs, slim, capacity)), "probed")
    # One row of each group has the doc_id that stays; of several the first by number, which sums up before it shuffles.
    first = found.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("bucket", "key", "chain").agg(F.min("_row").alias("_row"))
    marked = found.join(first.select("_row", F.lit(True).alias("_first")), "_row", "left")
    return marked.select("doc_id", "keep_id", "group_size", F.col("_first").isNotNull().alias("kept"), "text_sha256", "key", "bucket", "depth", "chain")


def extend(index: DataFrame, docs: DataFrame, capacity: int = CAPACITY) -> tuple[Directory, DataFrame]:
    """A new directory and index over the documents of a written one and more documents."""
    return build_index(docs, cut(keys(docs), "keys"), capacity, index)


def deduplicate(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    kept = group_copies(docs, capacity).where("kept").select(F.col("doc_id").alias("__dedup_id"), F.col("key").alias("__dedup_key"), F.col("text_sha256").alias("__dedup_sha"))
    text = text_or_empty(docs)
    keyed = docs.withColumn("__dedup_k", F.xxhash64(text)).withColumn("__dedup_s", F.sha2(text.cast("binary"), 256))
    joined = keyed.join(kept, keyed["__dedup_k"].eqNullSafe(kept["__dedup_key"]) & (keyed["__dedup_s"] == kept["__dedup_sha"]) & keyed["doc_id"].eqNullSafe(kept["__dedup_id"]))
    once = joined.withColumn("__dedup_n", F.row_number().over(W.partitionBy("__dedup_k", "__dedup_s", "__dedup_id").orderBy(F.lit(0))))
    return once.where("__dedup_n = 1").select(*[docs[c] for c in docs.columns])


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return group_copies(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (body)
"""
