"""License scans by ordered signature rules.

Some 250 hand-written expressions (license_rules) are gated by keywords: one pass of an Aho-Corasick automaton finds
which keywords a text has, and only the rules behind them are searched. Detections are taken in order of
priority, then length, then place, then rule; one that lies within an accepted detection is suppressed, and so is one of a
catch-all rule that overlaps a named license. Three base
phrases are found besides by words and never suppressed. Labels are those of both; the score is the highest
confidence of an accepted detection (0.5 for a base phrase).

Whole texts are scanned, with A-Z lower-cased. A null text is empty: no words, no labels, score 0. Spans are
byte offsets. Equal rows get equal results, an empty table an empty result, other columns don't matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tokenloom.llm.common import ALNUM, column_bytes, map_slices, per_row, text_or_empty, word_bounds
from tokenloom.llm.license_rules import TEXT

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
BASE_SCORE = 0.5
#: The label of rules that see that there is a license but not which.
CATCH_ALL = "unknown-license"
_WORD = rb"[0-9a-z\x80-\xff]"
_GAP = rb"[^0-9a-z\x80-\xff]+"
_BASE = [(label, phrase.split()[-1].encode(), re.compile(rb"(?<!" + _WORD + rb")" + _GAP.join(w.encode() for w in phrase.split()) + rb"(?!" + _WORD + rb")")) for phrase, label in BASE.items()]


@cache
def rules() -> tuple[object, list[list[int]], list[tuple[str, int, float, re.Pattern]]]:
    """The keyword automaton, the rules behind each keyword, and the rules in order."""
    import ahocorasick

    found, by_keyword = [], {}
    for line in TEXT.strip().splitlines():
        label, priority, confidence, keywords, expression = line.split(" ~ ", 4)
        for keyword in keywords.split("|"):
            by_keyword.setdefault(keyword, []).append(len(found))
        found.append((label, int(priority), int(confidence) / 100, re.compile(expression.replace(" ", r"(?:[\s*/#;:-]+)").encode())))
    automaton = ahocorasick.Automaton()
    for k, keyword in enumerate(by_keyword):
        automaton.add_word(keyword, k)
    automaton.make_automaton()
    return automaton, list(by_keyword.values()), found


def suppress(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of (start, end, priority, rule) those that lie in no earlier accepted one, in order of start."""
    starts = sorted({s for s, *_ in found})
    rank = {s: i + 1 for i, s in enumerate(starts)}
    reach = [0] * (len(starts) + 1)  # Fenwick tree: the furthest end of accepted intervals that start at or before
    out = []
    for item in sorted(found, key=lambda d: (-d[2], d[0] - d[1], d[0], d[3])):
        start, end = item[:2]
        i, furthest = rank[start], 0
        while i:
            furthest = max(furthest, reach[i])
            i &= i - 1
        if furthest >= end:
            continue
        out.append(item)
        i = rank[start]
        while i < len(reach):
            reach[i] = max(reach[i], end)
            i += i & -i
    return sorted(out)


def without_catch_alls(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Detections in order of start without those of catch-all rules that overlap one of a named license."""
    known = rules()[2]
    named = [d for d in found if known[d[3]][0] != CATCH_ALL]
    starts = [d[0] for d in named]
    reach = list(accumulate((d[1] for d in named), max))
    out = []
    for d in found:
        before = bisect_left(starts, d[1])  # named ones that begin before this ends
        if known[d[3]][0] != CATCH_ALL or not before or reach[before - 1] <= d[0]:
            out.append(d)
    return out


def detect(low: bytes) -> list[tuple[int, int, int, int]]:
    """Accepted detections (start, end, priority, rule) in a lower-cased text."""
    automaton, behind, known = rules()
    found = []
    for r in {r for k in {k for _, k in automaton.iter(low.decode("latin-1"))} for r in behind[k]}:
        _, priority, _, expression = known[r]
        found += [(m.start(), m.end(), priority, r) for m in expression.finditer(low) if m.end() > m.start()]
    return without_catch_alls(suppress(found)) if found else []


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long, detections array<struct<label:string,start:long,end:long,priority:int>>"


def _scan(batch: pa.RecordBatch) -> dict[str, list]:
    data, offsets = column_bytes(batch.column("text"))
    starts, _ = word_bounds(data, offsets, ALNUM)
    cuts = per_row(starts, offsets)
    low = data.tobytes().lower()
    known = rules()[2]
    names = [part.split(" ", 1)[0].removesuffix(":") for part in SCHEMA.split(", ")]
    rows = {c: [] for c in names}
    for i in range(batch.num_rows):
        text = low[offsets[i] : offsets[i + 1]]
        own = starts[cuts[i] : cuts[i + 1]] - offsets[i]
        places, base = [], set()
        for label, last, expression in _BASE:
            if last in text:
                at = [m.start() for m in expression.finditer(text)]
                places += at
                base |= {label} if at else set()
        found = detect(text)
        labels = base | {known[d[3]][0] for d in found}
        words = np.searchsorted(own, np.array(places, np.int64)) if places else []
        values = (
            len(own), len(places), int(min(words)) if places else None, int(max(words)) if places else None, ",".join(sorted(base)), ",".join(sorted(labels)),
            max([BASE_SCORE] * bool(places) + [known[d[3]][2] for d in found], default=0.0), len(found),
            [{"label": known[d[3]][0], "start": d[0], "end": d[1], "priority": d[2]} for d in found],
        )
        for c, x in zip(names, values, strict=True):
            rows[c].append(x)
    return rows


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts, labels, score and detections of every row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL(SCHEMA).fields])
    detection = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("priority", pa.int32())]))
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64(), detection]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [pa.array(x, t) for x, t in zip(_scan(batch).values(), types, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=schema.names)

    return map_slices(docs.select("doc_id", text_or_empty(docs).cast("binary").alias("text")), kernel, schema)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")
