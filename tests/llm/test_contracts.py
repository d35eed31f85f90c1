"""Awkward tables, and every operator against a brute-force version on small ones."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F


from tokenloom.llm import alignment, bpe, chat, exact_dedup, licenses, line_dedup, mixing, near_dedup, quality, sharding, wavelet

WORDS = re.compile("[^\x20\x09-\x0d]+")


def make(spark, rows):
    """documents with extra columns whose names the operators use themselves."""
    names = {"key": "long", "hash": "string", "size": "int", "kept": "string", "node": "string", "row_hash": "string", "n": "int", "row": "int", "class": "string"}
    given = spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string")
    return given.select("*", *[F.lit(1).cast(kind).alias(name) for name, kind in names.items()])


def prose(r, n, words=400):
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def plain(df):
    return [r.asDict(recursive=True) for r in df.collect()]


DEFAULTS = quality.DEFAULT
VOCABULARY = wavelet.public_vocabulary()


def shards(docs):
    from tokenloom.llm.common import scratch_path

    return wavelet.read_shards(wavelet.write_shards(docs, VOCABULARY, scratch_path(docs.sparkSession, "wm")))


OPERATORS = {
    "lines": line_dedup.remove_repeats, "licenses": licenses.scan, "near": near_dedup.near_classes, "bpe": lambda d: bpe.digests(d, *bpe.public_vocabulary()),
    "mix": mixing.mix, "quality": lambda d: quality.judge(d, DEFAULTS), "wavelet": shards, "shard": sharding.shard, "exact": exact_dedup.group_copies,
}
STAGES = {"quality": lambda d: quality.keep(d, DEFAULTS), "exact": exact_dedup.deduplicate, "near": near_dedup.representatives, "mix": mixing.mixture}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_tables(spark, awkward, nothing, name):
    assert OPERATORS[name](awkward).count() == awkward.count()
    assert OPERATORS[name](nothing).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_return_the_columns_of_documents(spark, awkward, nothing, name):
    out = STAGES[name](awkward)
    assert out.columns == awkward.columns and out.count() > 0
    given = {(r["doc_id"], r["text"]) for r in awkward.collect()}
    assert {(r["doc_id"], r["text"]) for r in out.collect()} <= given
    assert STAGES[name](nothing).count() == 0


def test_exact_copies(spark, awkward):
    found = plain(exact_dedup.group_copies(awkward))
    texts = collections.defaultdict(list)
    for r in awkward.collect():
        texts[r["text"] or ""].append(r["doc_id"])
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in texts.items()}
    for r in found:
        ids = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    kept = collections.Counter(r["text_sha256"] for r in found if r["kept"])
    assert kept == dict.fromkeys(by_sha, 1)
    assert exact_dedup.deduplicate(awkward).count() == len(texts)


def test_directory_splits_until_buckets_fit(spark):
    r = random.Random(1)
    keys = [r.getrandbits(64) - (1 << 63) for _ in range(1500)] + [r.getrandbits(54) for _ in range(300)]  # the latter share ten leading bits
    rows = spark.createDataFrame([(k,) for k in keys], "key long")
    known = exact_dedup.directory(rows, 50)
    found = plain(known.find(rows))
    assert sorted(r["key"] for r in found) == sorted(keys)
    by = collections.defaultdict(list)
    for row in found:
        by[row["bucket"], row["depth"]].append(row["key"] % (1 << 64))
    most = 6 + exact_dedup.SPLITS
    for (bucket, depth), own in by.items():
        assert {k >> (64 - depth) for k in own} == {bucket >> (most - depth)} and (len(own) <= 50 or depth == most)
        above = [k % (1 << 64) for k in keys if k % (1 << 64) >> (65 - depth) == own[0] >> (65 - depth)]
        assert depth == 6 or len(above) > 50  # no bucket is split without need
    assert len({d for _, d in by}) > 2 and known.slots.count() <= 1 << known.bits
    assert exact_dedup.directory(rows.limit(0), 10).find(rows.limit(0)).count() == 0


def test_index_answers_and_grows(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 170).alias("text"))
    slim = exact_dedup.cut(exact_dedup.keys(docs), "keys")
    known, index = exact_dedup.build_index(docs, slim, 16)
    assert exact_dedup.probe(slim, known, index).count() == 600 and index.select("bucket").distinct().count() > 4
    assert exact_dedup.probe(slim, known, index.withColumn("bucket", F.col("bucket") + 1)).count() == 0
    some, rest = docs.where("doc_id < 200"), docs.where("doc_id >= 200")
    _, first = exact_dedup.build_index(some, exact_dedup.cut(exact_dedup.keys(some), "keys"), 16)
    _, grown = exact_dedup.extend(first, rest, 16)
    order = lambda df: sorted(map(tuple, df.select("bucket", "depth", "key", "chain", "text_sha256", "keep_id", "group_size").collect()))
    assert order(grown) == order(index)


def test_hot_group(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 700)).alias("text"))
    found = plain(exact_dedup.group_copies(rows, capacity=16))
    sizes = {r["text_sha256"]: r["group_size"] for r in found}
    assert sizes[hashlib.sha256(b"hot").hexdigest()] == 1000 and sum(r["kept"] for r in found) == len(sizes)


def test_shards(spark):
    for n in (1, 2, 5, 17, 400):
        docs = spark.createDataFrame([(i, None if i == 3 else "é" * (i % 50)) for i in range(n)], "doc_id long, text string")
        rows = plain(sharding.shard(docs))
        assert sorted(r["row"] for r in rows) == list(range(n)) == [r["doc_id"] for r in sorted(rows, key=lambda r: r["row"])]
        by = collections.defaultdict(list)
        for r in rows:
            by[r["shard"]].append(r["slot"])
            t = "" if r["doc_id"] == 3 else "é" * (r["doc_id"] % 50)
            assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode())
        counts = [len(by[s]) for s in range(16)]
        assert max(counts) - min(counts) <= 1 and all(sorted(s) == list(range(len(s))) for s in by.values())
        again = {r["doc_id"]: (r["shard"], r["slot"]) for r in plain(sharding.shard(docs.repartition(7)))}
        assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        for r in rows:  # the network once more, in plain arithmetic
            x = r["row"]
            while True:
                left, right = divmod(x, b)
                for i, (u, v, w) in enumerate(sharding.round_keys(sharding.SEED)):
                    half = right if i % 2 == 0 else left
                    once = (half * u + v) % sharding.PRIME
                    f = (once * once + w * once + half) % sharding.PRIME
                    left, right = ((left + f) % a, right) if i % 2 == 0 else (left, (right + f) % b)
                x = left * b + right
                if x < n:
                    break
            assert (r["shard"], r["slot"]) == (x % 16, x // 16)
    order = [r["shard"] * 1000 + r["slot"] for r in sorted(rows, key=lambda r: r["row"])]
    assert order != sorted(order)


def test_mix(spark):
    r = random.Random(3)
    rows = [(i, prose(r, min(3000, int(r.paretovariate(1) * 20))), r.choice(["b", "a", None, "ä", "B"])) for i in range(1500)]
    rows += [(2000 + i, "small source", "tiny") for i in range(3)] + [(3000, None, "empty"), (3001, "", "a")]
    docs = make(spark, rows)
    found = plain(mixing.mix(docs))
    size = {i: len(WORDS.findall(t or "")) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    totals = collections.Counter()
    for i, n in size.items():
        totals[source[i]] += n
    names = sorted(s for s in totals if s is not None) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(totals.values()))
    while free:  # the excess is shared again until nobody is above
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * totals[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        for s in over:
            target[s] = 3.0 * totals[s]
            left -= target[s]
        free -= over
    taken = collections.Counter()
    for f in found:
        s = source[f["doc_id"]]
        assert f["size"] == size[f["doc_id"]] and f["source_size"] == totals[s] and f["target"] == pytest.approx(target[s])
        assert 0 <= f["taken"] <= 3 * f["size"] and f["taken"] == f["size"] * f["copies"]
        taken[s] += f["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= max(3, 0.002 * target[s])
    assert {(f["doc_id"], f["taken"]) for f in plain(mixing.mix(docs.repartition(5)))} == {(f["doc_id"], f["taken"]) for f in found}
    copies = collections.Counter(x["doc_id"] for x in plain(mixing.mixture(docs).select("doc_id")))
    assert copies == {f["doc_id"]: f["copies"] for f in found if f["copies"]}


def base_counts(text):
    w = WORDS.findall(text)
    grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_counts(spark, awkward):
    r = random.Random(4)
    texts = ["".join(r.choices("ab# \n\té|", k=r.randrange(300))) for _ in range(60)] + [prose(r, 80, 3) for _ in range(10)]
    docs = make(spark, [(i, t, "s") for i, t in enumerate(texts)]).select("doc_id", "text").union(awkward.select("doc_id", "text"))
    given = collections.Counter((i, base_counts(t or "")) for i, t in docs.collect())
    found = plain(quality.judge(docs, DEFAULTS))
    assert collections.Counter((f["doc_id"], tuple(f[c] for c in quality.COUNTS)) for f in found) == given
    for f in found:
        assert f["base_failed"] == (f["n_words"] < 20 or 100 * f["n_repeat_words"] > 30 * f["n_words"]) and not (f["kept"] and f["base_failed"])


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(5)
    chain = quality.Chain((), ((0.3, -0.7), (-0.2, 0.6)), (0.1, -0.4))
    lengths = [1, 4, 2, 6, 1, 5]
    rows = np.concatenate([[0], np.cumsum(lengths)])
    scores = r.normal(size=rows[-1])
    labels = quality.viterbi(scores, rows, chain)
    value = lambda e, y: chain.first[y[0]] + sum(e[i] * y[i] for i in range(len(y))) + sum(chain.moves[a][b] for a, b in itertools.pairwise(y))
    for a, b in itertools.pairwise(rows):
        best = max(value(scores[a:b], y) for y in itertools.product((0, 1), repeat=b - a))
        assert value(scores[a:b], labels[a:b].tolist()) == pytest.approx(best)


def test_fit_learns_held_out_lines(spark):
    r = random.Random(6)
    good = lambda: "\n".join(prose(r, 12) + "." for _ in range(6))
    bad = lambda: "\n".join(" | ".join(f"w{r.randrange(50)}" for _ in range(8)) for _ in range(6))
    rows = [(i, good() if i % 2 else bad(), "s") for i in range(120)]
    docs = make(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    chain = quality.fit_on(docs, labels)
    held = [f for f in plain(quality.judge(docs, chain)) if f["doc_id"] >= 60]
    assert all(f["kept"] == bool(f["doc_id"] % 2) for f in held)
    assert quality.fit_on(docs, labels.limit(0)) == quality.DEFAULT


@pytest.mark.parametrize("roll", [2, 4])
def test_chunks_line_by_line(monkeypatch, roll):
    """Chunk boundaries by a loop over lines in plain integers; those after an insertion come back."""
    monkeypatch.setattr(line_dedup, "ROLL", roll)
    r = random.Random(roll)
    whole = (1 << 64) - 1

    def scramble(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * factor & whole
        return x ^ x >> 31

    def hashed(line):
        raw = np.frombuffer(line.encode(), np.uint8)
        return int(line_dedup.span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])

    def firsts(lines):
        out, begin = [0], 0
        for i in range(len(lines) - 1):
            window = sum(hashed(lines[i - j]) * int(line_dedup.BASE) ** j for j in range(roll)) if i >= roll - 1 else None
            cut = window is not None and scramble(window & whole) % line_dedup.DIVISOR == 0 and i - begin + 1 >= line_dedup.LEAST_LINES
            if cut or i - begin + 1 == line_dedup.MOST_LINES:
                begin = i + 1
                out.append(begin)
        return out

    docs = [[f"line {r.randrange(300)}" for _ in range(r.randrange(1, 120))] for _ in range(30)] + [["same"] * 50, [""]]
    raws = ["\n".join(d).encode() for d in docs]
    c = line_dedup.Chunks(np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)]))
    for i, d in enumerate(docs):
        assert (c.first[c.rows[i] : c.rows[i + 1]] - c.line_rows[i]).tolist() == firsts(d)
    long = [f"line {r.randrange(300)}" for _ in range(100)]
    before, after = set(firsts(long)), {x - 3 for x in firsts([*"xyz", *long])}
    assert len([x for x in before if x > 20] and {x for x in before if x > 20} & after) >= 0.9 * len([x for x in before if x > 20])


def test_catch_alls_give_way_to_named_licenses(spark):
    texts = ["Licensed under the GPL-3.0-only license. GNU General Public License v3", "licensed under the creative commons attribution noncommercial 4.0 license", "licensed under the frobnitz", "nothing here"]
    labels = [set(f["labels"].split(",")) for f in sorted(plain(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))), key=lambda f: f["doc_id"])]
    assert "unknown-license" not in labels[0] | labels[1] and labels[2] == {"unknown-license"} and labels[3] == {""}


def test_license_base_columns_by_brute_force(spark, awkward):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    r = random.Random(18)
    vocabulary = ["mit", "license", "apache", "general", "public", "License,", "MIT", "x1", "é", "-", "\n", "licenses"]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(40))) for i in range(60)] + [(1000 + i, t["text"]) for i, t in enumerate(awkward.select("text").collect())]
    texts = dict(rows)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for f in plain(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))):
        words = word.findall((texts[f["doc_id"]] or "").translate(low))
        places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        assert (f["n_words"], f["n_base"]) == (len(words), len(places))
        assert (f["first_word"], f["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert f["base_labels"] == ",".join(sorted({label for _, label in places}))


def test_layout_is_no_evidence_and_junk_goes(spark):
    """Clean prose stays however its lines are broken; rows of cells go; string ids and repeated labels are no hindrance."""
    r = random.Random(17)
    good = lambda: "\n".join(prose(r, 30).capitalize() + "." for _ in range(4))
    bad = lambda: "\n".join("$$ " + " | ".join(f"w{r.randrange(90)}" for _ in range(8)) + " ##" for _ in range(6))
    rows = [(str(i), good() if i % 2 else bad()) for i in range(160)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id string, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)] * 2, "doc_id long, quality int")
    chain = quality.fit_on(docs, labels)
    assert quality.fit_on(docs.repartition(5), labels) == chain
    errors = quality.held_out(docs, labels)
    assert errors["good"] + errors["junk"] == 80 and errors["good_lost"] == errors["junk_kept"] == 0
    forms = [quality.broken(good(), width, bare) for width in (2, 4, 8, 20) for bare in (False, True)]
    assert all(f["kept"] for f in plain(quality.judge(spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string"), chain)))


def test_bpe_equals_tiktoken(spark, awkward):
    import tiktoken

    path, source = bpe.public_vocabulary()
    model = tiktoken.Encoding("own", pat_str=source, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    r = random.Random(7)
    alphabet = [chr(r.choice([r.randrange(32, 127), r.randrange(9, 14), r.randrange(0x80, 0x3000), r.randrange(0xE000, 0x10FFFF), 32, 39])) for _ in range(800)]
    texts = ["", "a" * 3000, "ab" * 700, "<|endoftext|>", " " * 300 + "x", "it's we'LL", None] + ["".join(r.choices(alphabet, k=60)) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for f in plain(bpe.digests(docs, path, source)):
        ids = model.encode_ordinary(texts[f["doc_id"]] or "")
        assert f["n_tokens"] == len(ids) and f["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert f["decoded_sha256"] == hashlib.sha256((texts[f["doc_id"]] or "").encode()).hexdigest()
    coded = bpe.encode(docs, path, source)
    assert {f["doc_id"]: bytes(f["decoded"]).decode() for f in plain(bpe.decode(coded, path, source))} == {i: t or "" for i, t in enumerate(texts)}


def test_wavelet_files_and_queries(spark, awkward):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(VOCABULARY)
    model.encode_special_tokens = True
    docs = awkward.where("doc_id is not null and coalesce(text, '') not like 'another%'").dropDuplicates(["doc_id"])
    start = 0
    found = sorted(plain(shards(docs)), key=lambda f: f["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for f in found:
        ids = [*model.encode(texts[f["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (f["start"], f["n_tokens"], f["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    r = random.Random(8)
    for n, m in ((0, 3), (1, 1), (600, 9), (40_000, 3000)):
        ids = np.array([r.randrange(m) for _ in range(n)], np.uint32)
        shard = wavelet.Shard(wavelet.write([None, 4], [0, n], ids))
        assert (shard.decode() == ids).all() and shard.doc_ids == [None, 4] and shard.count(m + 1) == 0
        for _ in range(20 if n else 0):
            i, t = r.randrange(n), int(ids[r.randrange(n)])
            a, b = sorted((r.randrange(n + 1), r.randrange(n + 1)))
            places = np.flatnonzero(ids == t)
            k = r.randrange(len(places))
            assert shard.access(i) == ids[i] and shard.count(t, a, b) == (ids[a:b] == t).sum() and shard.locate(t, k) == places[k]


def test_licenses(spark, awkward):
    found = {f["doc_id"]: f for f in plain(licenses.scan(awkward)) if f["doc_id"] is not None}
    f = found[8]
    assert (f["n_words"], f["n_base"], f["first_word"], f["last_word"], f["base_labels"]) == (7, 3, 0, 4, "gpl,mit") and set(f["labels"].split(",")) >= {"gpl", "mit"}
    assert found[4]["labels"] == "" and found[4]["first_word"] is None and found[4]["score"] == 0
    texts = {
        1: "Licensed under the Apache License, Version 2.0 (the License)", 2: "SPDX-License-Identifier: MIT-0", 3: "a permit license isn't one, mit licenses neither",
        4: "under the GNU General Public\n * License version 3", 5: "This is free and unencumbered software released into the public domain.", 6: "gut mit licht",
    }
    got = {f["doc_id"]: f for f in plain(licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))}
    assert "apache-2.0" in got[1]["labels"] and got[2]["labels"] == "mit-0" and got[3]["n_base"] == 0 and "gpl-3.0" in got[4]["labels"] and "unlicense" in got[5]["labels"] and got[6]["labels"] == ""
    r = random.Random(9)
    for _ in range(200):
        items = [(a, a + r.randrange(1, 9), r.randrange(4), k) for k in range(12) for a in [r.randrange(20)]]
        accepted = []
        for d in sorted(items, key=lambda d: (-d[2], d[0] - d[1], d[0], d[3])):
            if not any(x[0] <= d[0] and d[1] <= x[1] for x in accepted):
                accepted.append(d)
        assert licenses.suppress(items) == sorted(accepted)


def edited(r, words, k):
    out = list(words)
    for _ in range(k):
        at = r.randrange(len(out) + 1)
        out[at : at + r.randrange(2)] = [f"e{r.randrange(10**6)}"] * r.randrange(2)
    return out


def test_near_duplicates(spark):
    r = random.Random(10)
    rows, group = [], {}
    for g in range(25):
        words = [f"g{g}x{r.randrange(3000)}" for _ in range(r.randrange(60, 300))]
        for c in range(r.choice([1, 2, 5])):
            i = len(rows)
            rows.append((i, " ".join(edited(r, words, len(words) // 25) if c else words).upper(), "s"))
            group[i] = g
    shared = [f"shared{k}" for k in range(60)]
    for k in range(6):  # a long passage in common doesn't make texts near
        group[len(rows)] = f"own{k}"
        rows.append((len(rows), " ".join([f"o{k}y{j}" for j in range(90)] + shared + [f"p{k}y{j}" for j in range(90)]), "s"))
    found = plain(near_dedup.near_classes(make(spark, rows)))
    classes = {f["doc_id"]: f["class_id"] for f in found}
    assert all((classes[a] == classes[b]) == (group[a] == group[b]) for a in group for b in group)
    assert {f["doc_id"] for f in found if f["kept"]} == set(classes.values()) and all(c == min(i for i in classes if classes[i] == c) for c in classes.values())


def test_split_sets_of_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", 5)
    r = random.Random(11)
    words = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(edited(r, words, 3)), "s") for i in range(60)]
    assert {f["class_id"] for f in plain(near_dedup.near_classes(make(spark, rows)))} == {0}


@pytest.mark.parametrize("words", [8, 20, 40, 100, 300, 1000])
def test_texts_at_the_threshold_share_a_sample(words):
    """Of pairs with scattered substitutions nine in ten at least meet, at every similarity from 0.8 on."""
    r = random.Random(words)
    for share in (0.2, 0.15, 0.1):
        edits, met, pairs = int(words * share + 1e-9), 0, 150
        if not edits:
            continue
        for _ in range(pairs):
            a = [f"w{r.randrange(3000)}" for _ in range(words)]
            b = list(a)
            for i in r.sample(range(words), edits):
                b[i] = f"x{r.randrange(10**6)}"
            raw = [" ".join(x).encode() for x in (a, b)]
            samples = near_dedup.sketch(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))[2]
            met += bool(((samples[:, 0] == samples[:, 1]) & (samples[:, 0] > 0)).any())
        assert met >= 0.9 * pairs, (words, share, met)


def test_no_link_is_lost_between_blocks(spark, monkeypatch):
    """Drifting chains, whose ends aren't alike, in blocks of three: classes equal those of all pairs that share a sample."""
    import pyarrow as pa

    from tokenloom.llm.common import column_bytes

    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", 3)
    r = random.Random(15)
    texts = []
    for g in range(2):
        words = [f"g{g}w{k}" for k in range(100)]
        for _ in range(25):
            words = edited(r, words, 5)
            texts.append(" ".join(words))
    _, _, samples = near_dedup.sketch(*column_bytes(pa.array([t.encode() for t in texts], pa.binary())))
    words = [near_dedup.words_of(t.encode()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if ((samples[:, i] == samples[:, j]) & (samples[:, i] > 0)).any() and alignment.within(words[i], words[j], int(0.2 * max(len(words[i]), len(words[j])) + 1e-9)):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    found = {f["doc_id"]: f["class_id"] for f in plain(near_dedup.near_classes(make(spark, [(i, t, "s") for i, t in enumerate(texts)])))}
    assert found == {i: find(i) for i in range(len(texts))}


def test_alignment():
    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(12)
    for _ in range(1500):
        a = [r.randrange(4) for _ in range(r.randrange(25))]
        b = edited(r, a, r.randrange(6)) if a and r.random() < 0.7 else [r.randrange(4) for _ in range(r.randrange(25))]
        d = full(a, b)
        assert alignment.distance(a, b) == d and all(alignment.within(a, b, k) == (d <= k) for k in (0, 1, d, d + 1, max(0, d - 1)))


def naive_lines(rows):
    """Chunks by the module's boundaries, but found text by text, and compared as strings."""
    import pyarrow as pa

    from tokenloom.llm.common import column_bytes

    chunks, seen, out = {}, {}, {}
    for i, text in rows:
        data, offsets = column_bytes(pa.array([(text or "").encode()], pa.binary()))
        c = line_dedup.Chunks(data, offsets)
        raw = data.tobytes()
        chunks[i] = [(raw[a:b], raw[a:e], bool(s)) for a, b, e, s in zip(c.starts, c.body_ends, c.ends, c.several, strict=True)]
        assert b"".join(x[1] for x in chunks[i]) == raw and all(n <= line_dedup.MOST_LINES for n in c.lines)
    for i in sorted(chunks):
        kept = []
        for k, (body, whole, several) in enumerate(chunks[i]):
            if several and seen.setdefault(body, (i, k)) != (i, k):
                continue
            kept.append(whole)
        out[i] = b"".join(kept).decode()
    return out


def test_line_dedup(spark):
    r = random.Random(13)
    passages = ["\n".join(prose(r, 9) for _ in range(12)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [prose(r, 9) for _ in range(r.randrange(12))]
        if r.random() < 0.6:
            parts.insert(r.randrange(len(parts) + 1), r.choice(passages))
        rows.append((i, "\n".join(parts)))
    rows += [(60, rows[0][1]), (61, None), (62, ""), (63, "one line"), (64, "one line"), (65, "\n" * 100)]
    found = {f["doc_id"]: f for f in plain(line_dedup.remove_repeats(make(spark, [(i, t, "s") for i, t in rows])))}
    expected = naive_lines(rows)
    assert {i: f["text"] or "" for i, f in found.items()} == expected
    assert found[61]["text"] is None and found[64]["line_dedup"]["removed_lines"] == 0 and sum(f["line_dedup"]["removed_lines"] for f in found.values()) > 50


def cheapest(roles):
    best = None
    for states in itertools.product((1, 2, 3), repeat=len(roles)):
        at, cost = 0, 0
        for role, q in zip(roles, states, strict=True):
            if (at, q) not in chat.MOVES:
                break
            cost += chat.MOVES[at, q][0] + chat._relabel(chat.state_of(role), q)
            at = q
        else:
            best = min(x for x in (best, cost + chat.ENDS[at][0]) if x is not None)
    return best


def test_chat_repair(spark, monkeypatch):
    r = random.Random(14)
    rows, given = [], {}
    for c in range(60):
        roles = [r.choice(["user", "assistant", "system", "Human", None, "tool"]) for _ in range(r.randrange(1, 7))]
        given[c] = roles
        rows += [(c, t, role, f"t{t}<|im_end|>" if t else None, "x") for t, role in enumerate(roles)]
    rows += [(None, None, "user", "a", "x"), (None, 1, "user", "b", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string").repartition(4)
    for size in (1024, 2):  # the second splits conversations into blocks
        monkeypatch.setattr(chat, "BLOCK", size)
        found = plain(chat.repair(table))
        assert len(found) == len(rows)
        costs = collections.Counter()
        for f in found:
            costs[f["conv_id"]] += f["cost"]
        assert all(costs[c] == cheapest(roles) for c, roles in given.items())
        for f in plain(chat.render(table)):
            heads = re.findall(r"<\|im_start\|>(\w+)\n", f["text"])
            assert heads[-1] == "assistant" and heads[heads[0] == "system" :: 2] == ["user"] * (len(heads[heads[0] == "system" :]) // 2) and f["text"].endswith("<|im_end|>\n")
            assert f["text"].count("<|im_end|>") == len(heads)
    assert chat.repair(table.limit(0)).count() == 0


def test_chats_of_all_kinds(spark, monkeypatch):
    """String ids, one turn number for all, repeated rows, very long texts, columns with names of the operator's own."""
    monkeypatch.setattr(chat, "BLOCK", 4)
    rows = [("a", None, "user", f"q{i}") for i in range(9)] + [("a", None, "user", "q0")] * 3 + [("b", 1, "user", "x" * 300_000), ("b", 2, "gpt", None), (None, 1, "assistant", "alone")]
    table = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("row", "block", "hash", "id", "none", "conv", "start", "turns", "n")})
    found = plain(chat.repair(table))
    assert len(found) == len(rows) and collections.Counter(f["conv_id"] for f in found) == {"a": 12, "b": 2, None: 1}
    texts = {f["conv_id"]: f for f in plain(chat.render(table))}
    assert texts["a"]["cost"] == 11 * chat.MERGE + chat.INSERT and texts["a"]["text"].count("q0") == 4 and len(texts["b"]["text"]) > 300_000
    assert texts[None]["cost"] == chat.INSERT and sorted({f["block"] for f in found if f["conv_id"] == "a"}) == [0, 1, 2]


@pytest.mark.parametrize("clash", [False, True])
def test_distinct_words_survive_clashing_hashes(monkeypatch, clash):
    from tokenloom.llm.common import NOT_SPACE, word_bounds

    if clash:
        monkeypatch.setattr(wavelet, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    r = random.Random(21)
    words = ["".join(r.choice("ab") for _ in range(r.randrange(1, 20))).encode() for _ in range(500)] + [b"x" * 9 + b"y" + b"x" * 9, b"x" * 19]
    raw = b" ".join(words)
    data = np.frombuffer(raw, np.uint8)
    starts, ends = word_bounds(data, np.array([0, len(data)]), NOT_SPACE)
    of, first = wavelet.distinct_words(data, starts, ends)
    assert [words[first[k]] for k in of] == words and len(first) == len(set(words))
    assert [len(x) for x in wavelet.distinct_words(data[:0], starts[:0], ends[:0])] == [0, 0]


def test_long_pieces_equal_the_library():
    """Pieces without a break, from just too long for one query to 20,000 bytes, random or periodic."""
    import tiktoken

    path, source = bpe.public_vocabulary()
    own = bpe.coder(path, source)
    model = tiktoken.Encoding("one", pat_str=r"[\s\S]+", mergeable_ranks=own.ranks, special_tokens={})
    r = random.Random(16)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "acgt", "0123456789abcdef", "日本語漢字かなカナ的一是", "-=_*#", "éèàü", "etaoin "]
    texts = ["".join(r.choice(a) for _ in range(n)) for a in alphabets for n in (129, 300, 2000)] + ["abc" * 2000, "x" * 5000, " " * 3001, "the" * 700 + "q" + "the" * 701]
    texts.append("".join(r.choice(alphabets[0]) for _ in range(20_000)))
    for _ in range(60):
        part = "".join(r.choice(r.choice(alphabets)) for _ in range(r.randrange(2, 12)))
        texts.append((part * 300)[: r.randrange(130, 900)])
    raws = [t.encode() for t in texts if t.encode() not in own.ranks]
    for raw, ids in zip(raws, own.contract_long(raws), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode_ordinary(raw.decode())
