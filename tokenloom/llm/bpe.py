"""Byte-level BPE as DuckDB recursive queries, one in-process database for each Python worker.

Texts are split by the vocabulary's pattern. The distinct pieces of a batch that the worker hasn't
met become token-position rows, at first one row a byte; each round joins neighbouring tokens with
the merge table, takes each piece's leftmost pair of least rank and contracts it, until
no piece has a pair left. Decoding joins ids with the vocabulary's bytes and puts them together by
ordered aggregation.

A null text is an empty one and has no tokens. Whole texts are encoded; a piece's result is kept
in the worker for its next occurrence, at most CACHE pieces at once. Within a round the row at a contracted
pair goes and its right neighbour becomes the merged token, so no row needs its neighbours' neighbours.

A piece of more than LONG bytes without a break is cut into chunks of CHUNK bytes, which are contracted as pieces are, and mended at the seams: the
tokens around a seam are contracted together, and where the first and the last of them come out as they went in, the result takes their
place. That is exact: contraction within two neighbouring tokens doesn't depend on what lies around them as long as nothing crosses
their outer edges, so ids are a text's encoding if every two neighbours are the encoding of their own bytes. Where a
window's edges move, it grows; so a piece that repeats a short pattern may be contracted whole, all pairs of the least rank at once
where no later pair of lower rank can come of them, and of that query only the rows of the last round are held
(USING KEY). Work and memory grow with a piece's length, not its square.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.common import map_slices, text_or_empty

CACHE = 400_000
LONG, CHUNK, REACH = 128, 16, 8
#: Rows of all rounds, or bytes decoded, by one query: bounds the database's memory.
ROWS, DECODE_BYTES = 1_000_000, 1 << 20
#: Text whose new pieces are learnt together: a query has a price of its own.
TOGETHER = 1 << 21

_SHORT = """
WITH RECURSIVE t(w, len, pos, tok, nxt) AS (
    SELECT w, len, pos, tok, nxt FROM start
    UNION ALL
    SELECT t.w, t.len - 1, t.pos - (t.pos > b.p)::INT, CASE WHEN t.pos = b.p + 1 THEN b.r ELSE t.tok END, CASE WHEN t.pos = b.p - 1 THEN b.r ELSE t.nxt END
    FROM t JOIN (
        SELECT t.w, min(m.rank * 1048576 + t.pos) // 1048576 AS r, min(m.rank * 1048576 + t.pos) % 1048576 AS p
        FROM t JOIN merges m ON m.pair = t.tok * 65536 + t.nxt GROUP BY t.w
    ) b ON b.w = t.w WHERE t.pos <> b.p
), last AS (SELECT w, min(len) AS len FROM t GROUP BY w)
SELECT w, list(tok ORDER BY pos) AS ids FROM t JOIN last USING (w, len) GROUP BY w ORDER BY w
"""

#: The same for long windows; only their last round is kept. ``alone`` says that a rank's merges must be done one by one.
_LONG = """
WITH RECURSIVE t(w, pos, step, tok, nxt) USING KEY (w, pos) AS (
    SELECT w, pos, 0, tok, nxt FROM start
    UNION ALL
    SELECT w, row_number() OVER (PARTITION BY w ORDER BY pos) - 1, step + 1, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos)
    FROM (
        SELECT w, step, pos, CASE WHEN coalesce(lag(cut) OVER (PARTITION BY w ORDER BY pos), false) THEN least_rank ELSE tok END AS tok, cut
        FROM (
            SELECT *, hit AND (CASE WHEN alone THEN pos = first_hit ELSE (row_number() OVER (PARTITION BY w, run ORDER BY pos)) % 2 = 1 END) AS cut
            FROM (
                SELECT *, min(CASE WHEN hit THEN pos END) OVER (PARTITION BY w) AS first_hit, bool_or(hit AND alone_here) OVER (PARTITION BY w) AS alone, CASE WHEN hit THEN pos - row_number() OVER (PARTITION BY w, hit ORDER BY pos) ELSE -1 - pos END AS run
                FROM (
                    SELECT t.w, t.step, t.pos, t.tok, min(m.rank) OVER (PARTITION BY t.w) AS least_rank, coalesce(m.rank = min(m.rank) OVER (PARTITION BY t.w), false) AS hit, m.alone AS alone_here
                    FROM t LEFT JOIN merges m ON m.pair = t.tok * 65536 + t.nxt
                ) WHERE least_rank IS NOT NULL
            )
        )
    ) WHERE NOT cut
), last AS (SELECT w, max(step) AS step FROM t GROUP BY w)
SELECT w, list(tok ORDER BY pos) AS ids FROM t JOIN last USING (w, step) GROUP BY w ORDER BY w
"""

#: Sorted rows go into the aggregation in their order: one thread, and string_agg keeps it.
_DECODE = """
SELECT d, string_agg(piece, '') AS hex
FROM (SELECT d, pos, piece FROM coded JOIN vocab USING (tok) ORDER BY d, pos)
GROUP BY d ORDER BY d
"""


@cache
def _pattern(source: str):
    """The pattern in Python's engine, with letters and numbers spelt out, which is several times as fast."""
    classes = {}
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))  # neither side of the gap is a letter or number
    for name in ("L", "N"):
        runs = regex.findall(rf"\p{{{name}}}+", every)
        classes[name] = "".join(f"\\U{ord(run[0]):08x}-\\U{ord(run[-1]):08x}" for run in runs)
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    plain = source.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{classes['L']}{classes['N']}]")
    plain = plain.replace(r"\p{L}", f"[{classes['L']}]").replace(r"\p{N}", f"[{classes['N']}]").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")
    ascii_only = source.replace(r"[^\s\p{L}\p{N}]", r"[^\t-\r A-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]").replace(r"\S", r"[^\t-\r ]").replace(r"\s", r"[\t-\r ]")
    return re.compile(plain), re.compile(ascii_only)


def pieces(text: str, source: str) -> list[str]:
    """The matches of the vocabulary's pattern, in order."""
    plain, ascii_only = _pattern(source)
    return (ascii_only if text.isascii() else plain).findall(text)


def merge_table(ranks: dict[bytes, int]) -> list[tuple[int, int, int, bool]]:
    """All (left, right, rank, alone): pairs of tokens whose joined bytes are a token of that rank."""
    below: dict[bytes, int] = {}  # least rank of a token that begins or ends with the key
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            for part in (token[:k], token[k:]):
                if rank < below.get(part, 1 << 30):
                    below[part] = rank
    out = []
    for token, rank in ranks.items():
        alone = below.get(token, 1 << 30) < rank
        for k in range(1, len(token)):
            left, right = ranks.get(token[:k]), ranks.get(token[k:])
            if left is not None and right is not None:
                out.append((left, right, rank, alone))
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Coder:
    """Encoder and decoder over one database; used within one Python worker."""

    def __init__(self, path: str, source: str) -> None:
        self.source = source
        self.ranks = read_ranks(path)
        self.known: dict[str, bytes] = {}
        self.names = {rank: token for token, rank in self.ranks.items()}
        self.lengths = np.zeros(max(self.names) + 1, np.int64)
        self.lengths[list(self.names)] = [len(token) for token in self.names.values()]
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        table = merge_table(self.ranks)
        merges = pa.table({"pair": pa.array([a * 65536 + b for a, b, _, _ in table], pa.int64()), "rank": pa.array([r for *_, r, _ in table], pa.int64()), "alone": pa.array([x for *_, x in table])})
        vocab = pa.table({"tok": pa.array(list(self.ranks.values()), pa.int64()), "piece": [token.hex() for token in self.ranks]})
        self.db.register("given_merges", merges)
        self.db.register("given_vocab", vocab)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given_merges; CREATE TABLE vocab AS SELECT * FROM given_vocab")

    def _contract(self, words: list[bytes], query: str) -> list[bytes]:
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths)
        tok = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        nxt = np.append(tok[1:], -1)
        nxt[ends - 1] = -(1 << 40)  # no pair begins at a piece's last byte
        of = np.repeat(np.arange(len(words)), lengths)
        start = pa.table({"w": of, "len": np.repeat(lengths, lengths), "pos": np.arange(len(tok)) - np.repeat(ends - lengths, lengths), "tok": tok, "nxt": nxt})
        self.db.register("start", start)
        ids = self.db.sql(query).to_arrow_table().column("ids").combine_chunks()
        self.db.unregister("start")
        flat, cuts = ids.values.to_numpy().astype("<u4").tobytes(), (4 * ids.offsets.to_numpy().astype(np.int64)).tolist()
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def contract(self, raws: list[bytes]) -> list[bytes]:
        """The ids of byte strings as little-endian 32-bit integers, by as many queries as ROWS asks for."""
        out = [b""] * len(raws)
        order = sorted(range(len(raws)), key=lambda i: len(raws[i]))
        at = 0
        while at < len(order):
            to, rows = at, 0
            query = _SHORT if len(raws[order[at]]) <= LONG else _LONG
            while to < len(order) and (query is _LONG or len(raws[order[to]]) <= LONG):
                n = len(raws[order[to]])
                rows += n * n // 2 if query is _SHORT else 8 * n
                if to > at and rows > ROWS:
                    break
                to += 1
            part = order[at:to]
            for i, ids in zip(part, self._contract([raws[i] for i in part], query), strict=True):
                out[i] = ids
            at = to
        return out

    def contract_long(self, raws: list[bytes]) -> list[bytes]:
        """The same for long strings: chunks first, then windows around their seams until these hold."""
        chunks = [[raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)] for raw in raws]
        distinct = list(set().union(*chunks))
        known = dict(zip(distinct, self.contract(distinct), strict=True))
        tokens = [np.frombuffer(b"".join([known[c] for c in cut]), "<u4") for cut in chunks]
        #: Places of each string's open seams (before which byte), and how far a window reaches to either side.
        seams = [{i: REACH for i in range(CHUNK, len(raw), CHUNK)} for raw in raws]
        while any(seams):
            windows: list[tuple[int, int, int, list[int]]] = []  # string, first and past its last token, seams
            for k, open_seams in enumerate(seams):
                if not open_seams:
                    continue
                ends = np.cumsum(self.lengths[tokens[k]])
                places = sorted(open_seams)
                reach = np.array([open_seams[p] for p in places])
                low = np.searchsorted(ends, np.array(places) - reach, side="right")
                high = np.minimum(np.searchsorted(ends, np.array(places) + reach, side="left") + 1, len(ends))
                for place, a, b in zip(places, low.tolist(), high.tolist(), strict=True):
                    if windows and windows[-1][0] == k and a < windows[-1][2]:
                        _, first, last, own = windows.pop()
                        windows.append((k, min(first, a), max(last, b), [*own, place]))
                    else:
                        windows.append((k, a, b, [place]))
            bodies = [b"".join(map(self.names.__getitem__, tokens[k][a:b].tolist())) for k, a, b, _ in windows]
            distinct = list(set(bodies))
            known = dict(zip(distinct, self.contract(distinct), strict=True))
            parts: dict[int, list[np.ndarray]] = {}
            done: dict[int, int] = {}
            for (k, a, b, own), body in zip(windows, bodies, strict=True):
                old, new = tokens[k], np.frombuffer(known[body], "<u4")
                holds = (a == 0 or new[0] == old[a]) and (b == len(old) or new[-1] == old[b - 1])
                for place in own:
                    if holds:
                        del seams[k][place]
                    else:
                        seams[k][place] = 2 * max(seams[k][p] for p in own)
                parts.setdefault(k, []).extend([old[done.get(k, 0) : a], new if holds else old[a:b]])
                done[k] = b
            for k, found in parts.items():
                tokens[k] = np.concatenate([*found, tokens[k][done[k] :]])
        return [t.tobytes() for t in tokens]

    def learn(self, words: set[str]) -> None:
        """Encode pieces and keep the ids as little-endian 32-bit integers."""
        short, long = [], []
        for word in words:
            raw = word.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.known[word] = rank.to_bytes(4, "little")
            else:
                (short if len(raw) <= LONG else long).append((word, raw))
        for group, contract in ((short, self.contract), (long, self.contract_long)):
            if group:
                self.known.update(zip([word for word, _ in group], contract([raw for _, raw in group]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        split = [pieces(text, self.source) for text in texts]
        new = set().union(*split) - self.known.keys()
        if len(self.known) + len(new) > CACHE:
            self.known = {}
            new = set().union(*split)
        self.learn(new)
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def decode(self, coded: list[np.ndarray]) -> list[bytes]:
        """The bytes of each sequence of ids."""
        out: list[bytes] = [b""] * len(coded)
        at = 0
        while at < len(coded):
            to, size = at, 0
            while to < len(coded) and (to == at or size + len(coded[to]) * 4 <= DECODE_BYTES):
                size += len(coded[to]) * 4
                to += 1
            lengths = np.array([len(x) for x in coded[at:to]], np.int64)
            before = np.cumsum(lengths) - lengths
            tok = np.concatenate(coded[at:to]).astype(np.int64)
            self.db.register("coded", pa.table({"d": np.repeat(np.arange(at, to, dtype=np.int32), lengths), "pos": np.arange(len(tok)) - np.repeat(before, lengths), "tok": tok}))
            found = self.db.sql(_DECODE).to_arrow_table()
            for d, text in zip(found.column("d").to_pylist(), found.column("hex").to_pylist(), strict=True):
                out[d] = bytes.fromhex(text)
            self.db.unregister("coded")
            at = to
        return out


_coders: dict[tuple[str, str], Coder] = {}


def coder(path: str, source: str) -> Coder:
    """This process's coder for a vocabulary."""
    if (path, source) not in _coders:
        _coders[path, source] = Coder(path, source)
    return _coders[path, source]


def _texts(column: pa.Array) -> list[str]:
    return [b.decode("utf-8", "replace") for b in pc.fill_null(column, b"").to_pylist()]


def encode(docs: DataFrame, path: str, source: str) -> DataFrame:
    """doc_id and ids (array of int) of every row."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        coded = coder(path, source).encode(_texts(batch.column("text")))
        cuts = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.frombuffer(b"".join(coded), "<i4")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return map_slices(docs.select("doc_id", text_or_empty(docs).cast("binary").alias("text")), kernel, schema, limit=TOGETHER)


def decode(coded: DataFrame, path: str, source: str) -> DataFrame:
    """doc_id and decoded bytes of every row of doc_id and ids; null ids decode to nothing."""
    kind = coded.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("decoded", T.BinaryType())])

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.array(x or [], np.int64) for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(coder(path, source).decode(ids), pa.binary())], names=["doc_id", "decoded"])

    size = F.expr("unhex(repeat('00', coalesce(size(ids), 0)))")
    return map_slices(coded.select("doc_id", "ids", size.alias("text")), kernel, schema, limit=TOGETHER)


def digests(docs: DataFrame, path: str, source: str) -> DataFrame:
    """Encode and decode every row in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256 and whether the bytes came back."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("whole", T.BooleanType())])

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = coder(path, source)
        texts = _texts(batch.column("text"))
        coded = own.encode(texts)
        decoded = own.decode([np.frombuffer(c, "<u4") for c in coded])
        columns = [
            batch.column("doc_id"), pa.array([len(c) // 4 for c in coded], pa.int64()),
            pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()), pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
            pa.array([d == t.encode() for d, t in zip(decoded, texts, strict=True)], pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_slices(docs.select("doc_id", text_or_empty(docs).cast("binary").alias("text")), kernel, schema, limit=TOGETHER)


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), *public_vocabulary())
