"""Jobs that were done in part before: one test for each."""

import itertools
import random
import re
import zlib

import numpy as np


def prose(r, n, words=4000):
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def documents(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def repeated_lines(texts, least):
    """By brute force: for each text its lines and which of those lie in a run of over ``least`` words that stands earlier, too."""
    seen, out = set(), []
    for text in texts:
        lines = text.split("\n")
        gone = set()
        for b in range(len(lines)):  # runs in order of their ends, each looked up before any later one is known
            for a in range(b + 1):
                run = tuple(lines[a : b + 1])
                if sum(len(x.split()) for x in run) > least:
                    if run in seen:
                        gone |= set(range(a, b + 1))
                    seen.add(run)
        out.append((lines, gone))
    return out


def test_line_dedup_takes_every_passage_of_over_50_words(spark, tmp_path):
    from tokenloom.llm.line_dedup import op1_line_dedup

    r = random.Random(21)
    # One long line, and runs of 2 to 7 lines, in otherwise different texts.
    passages = [[prose(r, 60)]] + [[prose(r, 51 // n + 1) for _ in range(n)] for n in range(2, 8)] + [[prose(r, 20), "", prose(r, 20), "", prose(r, 20)]]
    texts = []
    for passage in passages:
        for _ in range(4):
            own = lambda: [prose(r, r.randrange(1, 70)) for _ in range(r.randrange(1, 4))]
            texts.append("\n".join([*own(), *passage, *own()]))
    short = [prose(r, 50), "\n".join([prose(r, 49), "x"])]  # 50 words aren't over 50
    texts += [f"{prose(r, 9)}\n{s}\n{prose(r, 9)}" for s in short[:1] for _ in range(3)]
    long = prose(r, 55)
    texts += [f"{long}\n{prose(r, 5)}\n{long}\n{long}", "", "\n".join([prose(r, 12)] * 8), f"{passages[0][0]}\n\n{long}"]
    found = {f["doc_id"]: f for f in op1_line_dedup(spark, documents(spark, tmp_path, texts)).collect()}
    for i, (lines, gone) in enumerate(repeated_lines(texts, 50)):
        if i == len(texts) - 1:
            gone = {0, 1, 2}  # the blank line between two removed lines goes along
        assert found[i]["text"].rstrip("\n") == "\n".join(x for k, x in enumerate(lines) if k not in gone).rstrip("\n"), i
        assert found[i]["removed_lines"] == len(gone)
    assert sum(f["removed_lines"] for f in found.values()) >= 3 * sum(map(len, passages)) + 4


def test_no_line_is_lost_with_all_its_copies(spark, tmp_path):
    from tokenloom.llm.line_dedup import op1_line_dedup

    r = random.Random(22)
    pool = [prose(r, r.choice([3, 10, 30, 60])) for _ in range(12)] + [""]
    texts = ["\n".join(r.choices(pool, k=r.randrange(1, 15))) for _ in range(60)]
    left = {x for f in op1_line_dedup(spark, documents(spark, tmp_path, texts)).collect() for x in f["text"].split("\n")}
    assert left >= set(itertools.chain.from_iterable(t.split("\n") for t in texts)) - {""}


def forms(parsed):
    """Texts of all alternatives of an expression, optional parts left out and put in."""
    out = [""]
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            own = [chr(value)]
        elif name == "IN":
            own = [chr(x) for k, x in value if str(k) == "LITERAL"] or ["1"]
        elif name == "BRANCH":
            own = [f for branch in value[1] for f in forms(branch)]
        elif name == "SUBPATTERN":
            own = forms(value[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, inner = value
            own = ([""] if least == 0 else []) + ([f * max(1, least) for f in forms(inner)] if most else [])
        else:
            own = ["" if name == "AT" else " "]
        out = [a + b for a in out for b in own]
    return out


def test_every_form_of_a_licence_rule_has_its_keyword():
    from tokenloom.llm import licenses
    from tokenloom.llm.license_rules import TEXT

    automaton, behind, known = licenses.rules()
    for r, line in enumerate(TEXT.strip().splitlines()):
        texts = [f for f in forms(re._parser.parse(line.split(" ~ ", 4)[4])) if known[r][3].search(f.encode())]
        assert texts, line
        for text in texts:
            searched = {x for _, k in automaton.iter(known[r][3].search(text.encode()).group().decode()) for x in behind[k]}
            assert r in searched, (line, text)


def test_licence_notices_without_the_usual_words(spark, tmp_path):
    from tokenloom.llm.licenses import op2_license_scan

    texts = ["No part may be reproduced without the prior written permission of Acme.", "Without express written permission of the author.", "For terms see the file COPYING.", "see copying.txt", "Without prior written consent of Acme.", "See the LICENSE file.", "a written permit for copying"]
    found = {f["doc_id"]: (f["labels"], f["score"], f["n_detections"]) for f in op2_license_scan(spark, documents(spark, tmp_path, texts)).collect()}
    own, unknown = ("proprietary", 0.6, 1), ("unknown-license", 0.2, 1)
    assert [found[i] for i in range(len(texts))] == [own, own, unknown, unknown, own, unknown, ("", 0.0, 0)]


def test_added_tokens_are_encoded_as_by_the_plain_library(spark, tmp_path):
    from tokenizers import Tokenizer

    from tokenloom.llm.wavelet import op7_wavelet_ids, public_vocabulary

    model = Tokenizer.from_file(public_vocabulary())
    texts = ["hi <|endoftext|> there", "plain", "<|endof", "text|> <|startoftext|>", "a<|STARTOFTEXT|>b<|endoftext|>", None, "<|endoftext|>", "<|endof text|>", "<|endoftext|><|endoftext|> é <|pad|>", "", "last words"]
    found = {f["doc_id"]: f for f in op7_wavelet_ids(spark, documents(spark, tmp_path, texts)).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        assert (found[i]["start"], found[i]["n_tokens"], found[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
        start += len(ids)
    assert 49407 in model.encode(texts[0], add_special_tokens=False).ids


def test_fit_doesnt_depend_on_repeated_doc_ids(spark):
    from tokenloom.llm import quality

    r = random.Random(23)
    good = lambda: "\n".join(prose(r, 12) + "." for _ in range(6))
    bad = lambda: "\n".join(" | ".join(f"w{r.randrange(50)}" for _ in range(8)) for _ in range(6))
    rows = [(0, good() + "\n" * (k % 7)) for k in range(400)] + [(i, good() if i % 2 else bad()) for i in range(1, 20)]
    labels = spark.createDataFrame([(i, int(i == 0 or i % 2)) for i in range(20)], "doc_id long, quality int")
    fits = [quality.fit_on(spark.createDataFrame(order, "doc_id long, text string").coalesce(1), labels, per_class=20) for order in (rows, rows[::-1])]
    assert fits[0] == fits[1] != quality.DEFAULT


def with_a_line_in_common(r, n, words=4000, own=6):
    """Texts that have a line in common and are otherwise different."""
    line = " ".join(f"common{k}" for k in range(12))
    return [f"{prose(r, own, words)}\n{line}\n{prose(r, own, words)}" for _ in range(n)]


def test_texts_with_a_line_in_common_dont_meet_in_every_two_blocks(spark, monkeypatch):
    from tokenloom.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", 10)
    rows = []
    for name in ("link_blocks", "meetings"):
        own = getattr(near_dedup, name, None)
        monkeypatch.setattr(near_dedup, name, lambda table, own=own: (rows.append(table.count()), own(table))[1], raising=False)
    texts = with_a_line_in_common(random.Random(24), 400)
    found = near_dedup.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(f["class_size"] == 1 for f in found)
    assert 400 < sum(rows) < 20 * 400, rows  # every two blocks of one set of all texts are 400 * 40 rows


def test_no_link_is_lost_among_frequent_words(spark, monkeypatch):
    """Chains of edits in texts with a line in common and few words besides: rare words of too many texts are paired, and what is
    left meets in blocks."""
    import pyarrow as pa

    from tokenloom.llm import alignment, near_dedup
    from tokenloom.llm.common import column_bytes

    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", 3)
    monkeypatch.setattr(near_dedup, "HOT_TEXTS", 4)
    meetings, called = near_dedup.meetings, []
    monkeypatch.setattr(near_dedup, "meetings", lambda keyed: (called.append(1), meetings(keyed))[1])
    r = random.Random(25)
    texts = []
    for text in with_a_line_in_common(r, 12, 25, 15):
        words = text.split()
        for _ in range(6):
            for i in r.sample(range(len(words)), 4):
                if not words[i].startswith("common"):
                    words[i] = f"w{r.randrange(25)}"
            texts.append(" ".join(words))
    samples = near_dedup.sketch(*column_bytes(pa.array([t.encode() for t in texts], pa.binary())))[2]
    words = [near_dedup.words_of(t.encode()) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if alignment.within(words[i], words[j], int(0.2 * max(len(words[i]), len(words[j])) + 1e-9))]
    root = list(range(len(texts)))
    for i, j in near:
        root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    found = {f["doc_id"]: f["class_id"] for f in near_dedup.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(called) == near_dedup.DEPTH + 1
    assert all(found[i] == found[j] for i, j in near if ((samples[:, i] == samples[:, j]) & (samples[:, i] > 0)).any())
    assert all(root[i] == root[found[i]] for i in found) and 1 < len(set(root)) < len(texts)


def test_two_large_classes_that_arent_linked_are_no_single_task(spark, monkeypatch):
    """Every two texts of two classes of the same words in another order must be aligned, but not in one task; unrelated ones of the same
    frequent words needn't be."""
    from tokenloom.llm import alignment, near_dedup

    monkeypatch.setattr(near_dedup, "ALIGN_PAIRS", 100, raising=False)
    parts, spread = [], near_dedup.spread

    def counted(table, *keys):
        out = spread(table, *keys)
        if "other_text" in table.columns:
            parts.extend(out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())
        return out

    monkeypatch.setattr(near_dedup, "spread", counted)
    r = random.Random(28)
    word = lambda: f"w{int(20000 * r.random() ** 4)}"
    first = [word() for _ in range(400)]
    second = first[200:] + first[:200]
    texts = [[*t[:k], word(), *t[k + 1 :]] for t in (first, second) for k in range(30)]
    texts += [[word() for _ in range(399)] + ["common"] for _ in range(100)]
    texts.append([w if i % 6 else word() for i, w in enumerate(texts[60])])
    groups = [0] * 30 + [30] * 30 + list(range(60, 161))
    links = {(i, j) for j in range(len(texts)) for i in range(j) if groups[i] != groups[j] and alignment.within(texts[i], texts[j], 80)}
    bodies = spark.createDataFrame([(i, " ".join(t).encode()) for i, t in enumerate(texts)], "node long, text binary")
    classes = spark.createDataFrame(list(enumerate(groups)), "node long, class long")
    found = near_dedup.rest_of_sets(bodies.selectExpr("7L AS sample", "node"), classes, bodies)
    assert {tuple(f) for f in found.collect()} == links == {(60, 160)}
    assert 900 <= sum(parts) < 950, parts  # of 100 unrelated texts alone every two are 4,950
    assert max(parts) < 0.6 * sum(parts), parts


def test_linked_texts_share_rare_words_by_any_order():
    """Of texts at the threshold, the first fifth and one more of the words meet, and so on for two and three words."""
    import pyarrow as pa

    from tokenloom.llm import alignment, near_dedup

    r = random.Random(26)
    for n in [*range(4, 30), 57, 200]:
        for _ in range(20):
            a = [r.randrange(n) for _ in range(n)]
            b = list(a)
            for _ in range(r.randrange(int(0.25 * n) + 2)):
                at = r.randrange(len(b))
                b[at : at + r.randrange(2)] = [r.randrange(n)] * r.randrange(2)
            if a == b or not alignment.within(a, b, int(0.2 * max(len(a), len(b)) + 1e-9)):
                continue
            batch = pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{x}" for x in t).encode() for t in (a, b)])], names=["text"])
            _, labelled, of, n_words = near_dedup._tokens(batch)
            for salt in range(3):
                order = near_dedup.mix(labelled ^ np.uint64(salt))
                sides = [[int(x) for x in np.sort(order[of == k])] for k in (0, 1)]
                both = sorted(set(sides[0]) & set(sides[1]))
                for depth in range(1, near_dedup.DEPTH + 1):
                    assert all(both[depth - 1] in side[: int(0.2 * len(side) + 1e-9) + depth] for side in sides)
