"""Sharding by a Feistel permutation of global row numbers; DataFrame and SQL functions only.

Every row gets a global number (its rank by doc_id, then by the text's CRC, size and digest), the
number is permuted within 0..N-1 by a six-round Feistel network over Z_a x Z_b with
a*b >= N, walking the cycle while the image lies outside; the image x goes to shard
``x mod shards`` and slot ``x div shards``. So the law is ``rows``: counts are at most one
apart and slots have no gaps, and both can be computed, and inverted, from N and the seed.

Null texts count as empty, null doc_ids come first. Rows that agree in doc_id and text are
interchangeable. The network's keyed function is arithmetic modulo a prime, so any engine can compute the places again
(``OP9_SQL`` does). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenloom.llm.common import cut, text_or_empty

ROUNDS, WALKS = 6, 64
SHARDS, SEED = 16, 20240917
#: The keyed function works modulo this prime; halves of row numbers are smaller up to 4.6e18 rows.
PRIME = (1 << 31) - 1


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Three numbers below PRIME for each round."""
    out, state = [], seed
    for _ in range(3 * ROUNDS):
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append((state >> 33) % (PRIME - 1) + 1)
    return [tuple(out[i : i + 3]) for i in range(0, len(out), 3)]


def keyed(x: str, a: str, b: str, c: str) -> str:
    """SQL for the keyed function of a half: multiply, add, square, add, all modulo PRIME; products stay below 2**62."""
    once = f"((({x}) * {a} + {b}) % {PRIME})"
    return f"(({once} * {once} + {c} * {once} + {x}) % {PRIME})"


def _network(x: str, seed: int) -> str:
    a, b, c = (f"array({', '.join(f'{k}L' for k in column)})[i]" for column in zip(*round_keys(seed), strict=True))
    even = f"named_struct('l', (s.l + {keyed('s.r', a, b, c)}) % a, 'r', s.r)"
    odd = f"named_struct('l', s.l, 'r', (s.r + {keyed('s.l', a, b, c)}) % b)"
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', {x} div b, 'r', {x} % b), (s, i) -> if(i % 2 = 0, {even}, {odd}), s -> s.l * b + s.r)"


def permuted(seed: int) -> str:
    """SQL for the permuted number of ``row`` among ``n`` rows; ``a`` and ``b`` are the network's moduli.

    Out-of-range images number less than b <= sqrt(n) + 1, so a walk of two steps is rare already; one
    that needed more than 64 would raise rather than give a wrong place.
    """
    return f"aggregate(sequence(1, {WALKS}), {_network('row', seed)}, (x, j) -> if(x < n, x, {_network('x', seed)}), x -> x)"


def number_rows(rows: DataFrame, order: list) -> DataFrame:
    """Add ``row`` (global number from 0 by ``order``) and ``n`` (of all rows), with no global window over the rows.

    Range partitions are sorted and written once; only the count of each partition is summed up, a
    table with one row for each partition, which is what is broadcast.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_count"))
    along = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(
        "_part",
        F.coalesce(F.sum("_count").over(along), F.lit(0)).alias("_before"),
        F.sum("_count").over(W.partitionBy()).alias("n"),
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(counts), "_part")
        .withColumn("row", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_before", "_at")
    )


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Return doc_id, size, text_crc32, row, n, shard and slot of every row."""
    text = text_or_empty(docs)
    slim = docs.select(
        docs["doc_id"],
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text.cast("binary"), 256).alias("_hash"),
    )
    numbered = number_rows(slim, [F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "_hash"])
    a = F.ceil(F.sqrt(F.col("n").cast("double")))
    placed = numbered.withColumn("a", a).withColumn("b", F.expr("(n + a - 1) div a"))
    placed = placed.withColumn("_x", F.expr(permuted(seed)))
    placed = placed.withColumn("_x", F.expr("if(_x < n, _x, raise_error('cycle walk did not end'))").cast("long"))
    return placed.select(
        "doc_id", "size", "text_crc32", "row", "n",
        (F.col("_x") % shards).cast("int").alias("shard"),
        F.expr(f"_x div {shards}").alias("slot"),
    )


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _network_sql(x: str) -> str:
    """The same network for DuckDB: one nested query a round, around rows with row, n, a and b."""
    query = f"SELECT *, {x} // b AS l0, {x} % b AS r0 FROM given"
    for i, (a, b, c) in enumerate(round_keys(SEED)):
        if i % 2 == 0:
            half = f"(l{i} + {keyed(f'r{i}', str(a), str(b), str(c))}) % a AS l{i + 1}, r{i} AS r{i + 1}"
        else:
            half = f"l{i} AS l{i + 1}, (r{i} + {keyed(f'l{i}', str(a), str(b), str(c))}) % b AS r{i + 1}"
        query = f"SELECT *, {half} FROM ({query})"
    return f"SELECT row, n, a, b, l{ROUNDS} * b + r{ROUNDS} AS x FROM ({query})"


def _crc_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        out.append(c)
    return out


OP9_SQL = f"""
WITH RECURSIVE bytes AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, hex(encode(coalesce(text, ''))) AS h FROM documents),
summed AS (
    SELECT doc_id, octet_length(raw) + 1 AS size, sha256(raw) AS digest,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)),
            lambda s, x: xor(s >> 8, ([{', '.join(map(str, _crc_table()))}]::BIGINT[])[(xor(s, x) & 255) + 1])), 4294967295) AS text_crc32
    FROM bytes),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size, digest) - 1 AS row, count(*) OVER () AS n FROM summed),
moduli AS (SELECT row, n, ceil(sqrt(n))::BIGINT AS a FROM numbered),
walked AS (
    SELECT * FROM (WITH given AS (SELECT *, (n + a - 1) // a AS b FROM moduli) {_network_sql('row')})
    UNION ALL
    SELECT * FROM (WITH given AS (SELECT * FROM walked WHERE x >= n) {_network_sql('x')}))
SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {SHARDS})::INTEGER AS shard, x // {SHARDS} AS slot, NULL::INTEGER AS grown_shard
FROM numbered JOIN walked USING (row) WHERE x < walked.n
"""
