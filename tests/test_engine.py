import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import word_document
from tokenloom.functions import text as T
from tokenloom.operators import compare as C
from tokenloom.operators import remap as R
from tokenloom.operators import selection as S
from tokenloom.operators import verify as V
from tokenloom.operators.counting import Counts, count_weighted, coverage_of
from tokenloom.operators.encode import count_tokens, decode, encode, encode_wordlevel, wordpiece_of
from tokenloom.operators.presets import available_presets, register_preset, resolve_preset
from tokenloom.sources.corpus import open_dataset, read_token_file, sample, texts
from tokenloom.sources.tokenizer import TokenizerDocument, join_templates, template_literals
from tokenloom.plans.config import Config, Dataset, Selecting, load_config, parse_overrides
from tokenloom.plans.run import TrimPipeline, copy_sidecars, guard, render

SAMPLES = ["the cat sat", "the dog", "a hat", "the the the", "at the"]


def ids_of(df, column="token_id"):
    return sorted(r[column] for r in df.select(column).collect())


def counts_table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "token_id int, n long")


# --- text functions


def test_byte_alphabet_and_surfaces(spark):
    letters = T.byte_letters()
    assert len(set(letters.values())) == 256 and letters[32] == "Ġ" and letters[10] == "Ċ" and letters[65] == "A"
    rows = spark.createDataFrame([("Ġde",), ("the",), (letters[0xA9],), ("→",), ("",), (letters[0xC3] + letters[0xA9],)], "token string")
    found = [r[0] for r in rows.select(T.byte_level_surface(F.col("token"))).collect()]
    assert found == [" de", "the", None, None, "", "é"]
    rows = spark.createDataFrame([("##ing",), ("▁cat",), ("a▁b",)], "token string")
    assert [r[0] for r in rows.select(T.marked_surface(F.col("token"), "##", "▁")).collect()] == ["ing", " cat", "a b"]


def test_spaces_agree_with_python(spark):
    points = [p for p in range(0x3100) if not 0xD800 <= p < 0xE000]
    rows = spark.createDataFrame([(p, chr(p)) for p in points], "p int, c string")
    found = {r["p"] for r in rows.where(F.col("c").rlike(f"^[{T.SPACES}]$")).collect()}
    assert found == {p for p in points if chr(p).isspace()}
    words = ["  a b\x85", "\x1c", "", "x"]
    assert [r[0] for r in spark.createDataFrame([(w,) for w in words], "s string").select(T.strip(F.col("s"))).collect()] == [w.strip() for w in words]


def test_scripts_and_kinds(spark):
    tokens = ["[UNK]", "the", "cat", "кот", "кошка", "γάτα", "catж", "123", "!!", "@#"]
    base = spark.createDataFrame([(t, i, t) for i, t in enumerate(tokens)], "token string, token_id int, surface string")
    found = {r["token"]: (r["script"], r["kind"]) for r in T.classified(base).collect()}
    assert found["the"] == ("LATIN", "letter") and found["кот"][0] == "CYRILLIC" and found["γάτα"][0] == "GREEK"
    assert found["catж"][0] == "mixed" and found["123"] == ("non-letter", "number") and found["!!"][1] == "punctuation"
    assert ids_of(T.in_script(base, "Cyrillic"), "token") == ["кот", "кошка"]
    more = spark.createDataFrame([("x", None), ("y", ""), ("z", "a1"), ("w", "1a"), ("s", " \t")], "token string, surface string")
    found = {r["token"]: r["kind"] for r in T.classified(more).collect()}
    assert found == {"x": "partial-bytes", "y": "other", "z": "letter", "w": "number", "s": "whitespace"}
    with pytest.raises(ValueError):
        T.in_script(base, " ")


# --- sources


def test_document(byte_level_bpe, wordpiece, unigram):
    doc = TokenizerDocument.from_json(byte_level_bpe)
    assert doc.uses_byte_level and doc.unk_token is None and doc.post_tokens == ["<|im_end|>"] and len(doc.structural) == 259
    doc = TokenizerDocument.from_json(wordpiece)
    assert doc.unk_token == "[UNK]" and doc.continuing_prefix == "##" and set(doc.post_tokens) == {"[SEP]", "[CLS]"} and doc.describe()["vocab_size"] == 39
    doc = TokenizerDocument.from_json(unigram)
    assert doc.unk_token == "<unk>" and doc.initial_prefix == "▁" and doc.structural == {"<unk>"}
    with pytest.raises(KeyError):
        TokenizerDocument.from_json('{"model": {"type": "Other"}}')


def test_template_literals():
    assert template_literals(None) == "" and join_templates({"a": "x", "b": "y"}) == "x\ny" and join_templates({}) is None
    found = template_literals("A{{ m['role'] }}B{% if x == \"tool_call\" %}{# note #}").split("\n")
    assert found[:6] == ["system", "user", "assistant", "tool", "function", "developer"]
    assert found[6:] == ["A", "B", "", "", "role", "tool_call"]


def test_corpus_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"text": t, "other": 1}) for t in ["the cat", "", "the dog", None]))
    rows = open_dataset(spark, Dataset(path="json", data_files=str(tmp_path / "a.jsonl")))
    assert texts(rows).count() == 2
    with pytest.raises(KeyError, match="other"):
        texts(rows, "content")
    assert open_dataset(spark, Dataset(path=str(tmp_path))).count() == 4
    (tmp_path / "b.txt").write_text("one\ntwo\n")
    assert open_dataset(spark, Dataset(path="text", data_files={"train": str(tmp_path / "b.txt")})).columns == ["text"]
    with pytest.raises(KeyError, match="train"):
        open_dataset(spark, Dataset(path="text", split="test", data_files={"train": str(tmp_path / "b.txt")}))
    (tmp_path / "c.csv").write_text("id,text\n1,hello there\n")
    assert texts(open_dataset(spark, Dataset(path="csv", data_files=[str(tmp_path / "c.csv")]))).first()["text"] == "hello there"
    keep = tmp_path / "keep.txt"
    keep.write_text("# a comment\n\nrun\n dog \n")
    assert read_token_file(keep) == ["run", "dog"]


def test_arrow_folder(spark, tmp_path):
    import pyarrow as pa

    folder = tmp_path / "saved" / "train"
    folder.mkdir(parents=True)
    table = pa.table({"text": SAMPLES})
    with pa.OSFile(str(folder / "data-0.arrow"), "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write_table(table)
    assert open_dataset(spark, Dataset(path=str(tmp_path / "saved"), load_from_disk=True)).count() == 5
    with pytest.raises(KeyError, match="train"):
        open_dataset(spark, Dataset(path=str(tmp_path / "saved"), load_from_disk=True, split="test"))


def test_limit_counts_raw_rows_and_sample_is_seeded(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["", "a", None, "b", "c"])], "i int, text string")
    assert ids_of(texts(rows, limit=3, order=["i"]), "i") == [1]
    docs = spark.createDataFrame([(i, str(i)) for i in range(100)], "doc_id int, text string")
    one, two = (sample(docs, 10, 5, "doc_id") for _ in range(2))
    assert ids_of(one, "doc_id") == ids_of(two, "doc_id") and one.count() == 10 and ids_of(sample(docs, 10, 6, "doc_id"), "doc_id") != ids_of(one, "doc_id")


# --- encoders


def test_wordlevel_and_wordpiece_joins(spark, wordlevel, wordpiece):
    doc = TokenizerDocument.from_json(wordlevel)
    docs = spark.createDataFrame([(0, "the cat flew"), (1, "")], "doc_id int, text string")
    found = encode_wordlevel(docs, doc.tables(spark)["vocab"], unk=0).orderBy("doc_id", "pos").collect()
    assert [r["token_id"] for r in found] == [1, 2, 0]
    doc = TokenizerDocument.from_json(wordpiece)
    words = ["the", "cats", "running", "dog", "zed", "x9", "q" * 70, "runs", "sated"]
    got = {r["token"]: r["ids"] for r in wordpiece_of(spark.createDataFrame([(w,) for w in words], "token string"), doc.tables(spark)["vocab"], 1, most=64).collect()}
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(wordpiece)
    assert got == {w: model.encode(w, add_special_tokens=False).ids for w in words}


@pytest.mark.parametrize("name", ["byte_level_bpe", "wordpiece", "unigram", "wordlevel"])
def test_document_encoders(spark, request, name):
    payload = request.getfixturevalue(name)
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(payload)
    docs = spark.createDataFrame(list(enumerate([*SAMPLES, ""])), "doc_id int, text string")
    got = {r["doc_id"]: r["ids"] for r in encode(docs, payload, ["doc_id"]).collect()}
    assert got == {i: model.encode(t, add_special_tokens=False).ids for i, t in enumerate([*SAMPLES, ""])}
    back = {r["doc_id"]: r["text"] for r in decode(encode(docs, payload, ["doc_id"]), payload, ["doc_id"]).collect()}
    assert back == {i: model.decode(ids, skip_special_tokens=False) for i, ids in got.items()}
    from collections import Counter

    expected = Counter(i for ids in got.values() for i in ids)
    counted = count_tokens(docs, payload).groupBy("token_id").agg(F.sum("n").alias("n"))
    assert {r["token_id"]: r["n"] for r in counted.collect()} == expected
    half = count_tokens(docs, payload, 0.5).groupBy("token_id").agg(F.sum("n").alias("n"))
    rounded = Counter()
    for ids in got.values():
        for t, k in Counter(ids).items():
            rounded[t] += round(k * 0.5)
    assert {r["token_id"]: r["n"] for r in half.collect()} == dict(rounded)


# --- counting and cuts


def test_counts(spark, tmp_path):
    counts = Counts(counts_table(spark, {1: 10, 2: 5, 3: 5, 4: 1}), 21, 3, ["x"])
    assert [r["token_id"] for r in counts.ranked_ids().collect()] == [1, 2, 3, 4] and counts.distinct() == 4
    assert counts.coverage_of([1]) == 10 / 21 and counts.coverage_of([]) == 0
    assert coverage_of(counts.counts.limit(0), counts.counts, 0).first()[0] == 1.0
    counts.save(tmp_path / "c.json")
    again = Counts.load(spark, tmp_path / "c.json")
    assert again.to_dict() == counts.to_dict() and again.total == 21


def test_weighted_counts_round_half_to_even_and_keep_zeros(spark):
    rows = spark.createDataFrame([(0, "a")] + [(1, "b")] * 3 + [(2, "a")] * 5, "doc int, token string").withColumn("w", F.lit(0.5))
    assert {r["token"]: r["n"] for r in count_weighted(rows, ["doc"], "w").collect()} == {"a": 0 + 2, "b": 2}


def test_cuts(spark):
    counts = counts_table(spark, {31: 100, 32: 50, 33: 10, 37: 1})
    cut = lambda **k: ids_of(S.cut_by_corpus(counts, total=161, **k))
    assert cut(top_k=2) == [31, 32] and cut(min_count=10) == [31, 32, 33] and cut(coverage=0.6) == [31]
    assert cut(coverage=1.0, top_k=1) == cut(top_k=1) == [31] and cut(coverage=1.0) == [31, 32, 33, 37]
    few = counts_table(spark, {1: 1, 2: 1})
    assert ids_of(S.cut_by_corpus(few, coverage=1.0, total=1000)) == [1, 2]
    zero = counts_table(spark, {1: 0, 2: 0})
    assert ids_of(S.cut_by_corpus(zero, coverage=0.5, total=0)) == [1]
    assert S.cut_by_corpus(few.limit(0), coverage=0.5, total=0).count() == 0


# --- dependencies and the cap


def deps_table(spark, deps):
    return spark.createDataFrame([(c, p, i) for c, ps in deps.items() for i, p in enumerate(ps)], "child int, parent int, slot int")


def naive(kept, structural, freq, deps, cap):
    kept, out = set(kept), []
    while len(kept) > cap:
        free = [t for t in kept - structural if not any(t in deps.get(c, ()) for c in kept)]
        if not free:
            break
        t = min(free, key=lambda t: (freq.get(t, 0), -t))
        kept.discard(t)
        out.append(t)
    return set(out)


def capped(spark, kept, structural, freq, deps, cap):
    nodes = spark.createDataFrame([(t, freq.get(t, 0), t in structural) for t in kept], "token_id int, freq long, structural boolean")
    return {r["token_id"] for r in S.apply_cap(nodes, deps_table(spark, deps), cap).collect()}


@pytest.mark.parametrize(
    ("deps", "cap", "structural", "left"),
    [({1: (0,), 2: (0,)}, 3, set(), {0, 2, 3}), ({1: (0,), 2: (0,)}, 1, set(), {3}), ({1: (0, 0)}, 2, set(), {2, 3}), ({1: (0,), 2: (0,)}, 1, {0}, {0}), ({0: (1,), 1: (2,), 2: (3,), 3: (0,)}, 1, set(), {0, 1, 2, 3})],
)
def test_cap_graphs(spark, deps, cap, structural, left):
    gone = capped(spark, {0, 1, 2, 3}, structural, {1: 1, 2: 2, 3: 100}, deps, cap)
    assert {0, 1, 2, 3} - gone == left == {0, 1, 2, 3} - naive({0, 1, 2, 3}, structural, {1: 1, 2: 2, 3: 100}, deps, cap)


def test_cap_equals_naive_greedy(spark):
    r = random.Random(5)
    for _ in range(2):
        n = 12
        deps = {c: tuple(r.randrange(c) for _ in range(2)) for c in range(4, n) if r.random() < 0.7}
        freq = {t: r.randrange(6) for t in range(n)}
        structural = {t for t in range(n) if r.random() < 0.15}
        cap = max(len(structural), r.randrange(1, n))
        assert capped(spark, set(range(n)), structural, freq, deps, cap) == naive(range(n), structural, freq, deps, cap)
    with pytest.raises(ValueError, match="structural"):
        capped(spark, {0, 1}, {0, 1}, {}, {}, 1)


def test_merge_dependencies_and_closure(spark):
    vocab = spark.createDataFrame([("<unk>", 0), ("t", 1), ("h", 2), ("e", 3), ("he", 4), ("the", 5)], "token string, token_id int")
    merges = spark.createDataFrame([(0, "h", "e"), (1, "t", "he"), (2, "x", "y"), (3, "th", "e")], "rank int, left string, right string")
    deps = S.merge_dependencies(merges, vocab)
    assert {(r["child"], r["slot"]): r["parent"] for r in deps.collect()} == {(4, 0): 2, (4, 1): 3, (5, 0): 1, (5, 1): 4}
    kept = spark.createDataFrame([(5,)], "token_id int")
    more = S.expand_dependencies(kept, deps)
    assert ids_of(more) == [1, 2, 3, 4]
    assert S.expand_dependencies(kept.union(more), deps).count() == 0


# --- rules and selection


def test_presets(spark, byte_level_bpe, wordpiece):
    doc = TokenizerDocument.from_json(byte_level_bpe)
    tables = doc.tables(spark)
    size = lambda name: resolve_preset(name, doc, tables).count()
    assert size("byte_alphabet") == 256 and size("digits") == 10 and size("special_tokens") == 3 and size("unk") == 0 and size("structural") == 259
    assert {r[0] for r in resolve_preset("ascii_letters", doc, tables).collect()} >= {"he", "the", "Ġthe", "Ġde", "a", "Z"}
    assert size("script:Latin") == size("ascii_letters") + 3  # the added tokens have Latin letters among others
    doc = TokenizerDocument.from_json(wordpiece)
    assert resolve_preset("byte_alphabet", doc, doc.tables(spark)).count() == 0 and resolve_preset("unk", doc, doc.tables(spark)).first()[0] == "[UNK]"
    with pytest.raises(KeyError, match="digits"):
        resolve_preset("nonsense", doc, doc.tables(spark))
    with pytest.raises(ValueError):
        register_preset("a:b")
    with pytest.raises(ValueError):
        register_preset("digits")(lambda d, t: None)
    assert "script:<argument>" in available_presets()


def test_selection_on_wordpiece(spark, wordpiece, tmp_path):
    doc = TokenizerDocument.from_json(wordpiece)
    tables, v = doc.tables(spark), doc.vocabulary
    counts = Counts(counts_table(spark, {v["the"]: 100, v["cat"]: 50, v["sat"]: 10, v["dog"]: 1}), 161, 4, [])
    keep = tmp_path / "keep"
    keep.write_text("# c\nrun\ndog\n")
    config = Selecting(top_k=2, keep_tokens=["kangaroo"], keep_token_files=[str(keep)], keep_patterns=["^ing$"], keep_texts=["sat"], keep_token_ids=[5])
    chosen = S.select_tokens(doc, tables, counts, config)
    names = {doc.id_to_token[i] for i in chosen.ids()}
    assert names >= {"the", "cat", "run", "dog", "##ing", "sat", "a", "[CLS]"} and "##ed" not in names and chosen.unknown == ["kangaroo"]
    by = chosen.by_reason()
    assert by["structural"] == 5 and by["corpus"] == 2 and by["pattern:^ing$"] == 1 and by["text"] == 1
    with pytest.raises(ValueError, match="does not exist"):
        S.select_tokens(doc, tables, counts, Selecting(keep_token_ids=[99999]))
    small = S.select_tokens(doc, tables, counts, Selecting(min_count=1, keep_tokens=["run"], max_vocab_size=7))
    assert len(small.ids()) == 7 and [r["reasons"] for r in small.dropped.collect()] == [["explicit_token"]]


def test_selection_closes_over_merges(spark, byte_level_bpe):
    doc = TokenizerDocument.from_json(byte_level_bpe)
    chosen = S.select_tokens(doc, doc.tables(spark), None, Selecting(keep_tokens=["the"]))
    found = {doc.id_to_token[r["token_id"]]: r["reasons"] for r in chosen.kept.where("NOT structural").collect()}
    assert found == {"the": ["explicit_token"], "he": ["dependency"]}


# --- renumbering


def test_remap(spark):
    kept = spark.createDataFrame([(7,), (2,), (5,), (2,)], "token_id int")
    assert [(r[0], r[1]) for r in R.dense_remap(kept).orderBy("old_id").collect()] == [(2, 0), (5, 1), (7, 2)]
    with pytest.raises(ValueError):
        R.dense_remap(spark.createDataFrame([(-1,)], "token_id int"))
    remap = R.dense_remap(spark.createDataFrame([(1,), (2,), (3,)], "token_id int"))
    seqs = spark.createDataFrame([(0, [3, 1]), (1, [1, 99]), (2, [])], "k int, ids array<int>")
    assert {r["k"]: r["ids"] for r in R.map_sequences(seqs, remap, "k").collect()} == {0: [2, 0], 1: None, 2: []}
    vocab = lambda tokens: spark.createDataFrame(tokens, "token string, token_id int")
    old = vocab([("a", 0), ("b", 1), ("c", 2), ("d", 3)])
    assert sorted(map(tuple, R.remap_between(old, vocab([("a", 0), ("c", 1), ("d", 2)])).collect())) == [(0, 0), (2, 1), (3, 2)]
    for bad in ([("a", 0), ("z", 1)], [("a", 0), ("b", 2)]):
        with pytest.raises(ValueError):
            R.remap_between(old, vocab(bad))


def test_gather_pad_and_bias(spark):
    table = spark.createDataFrame([(i, [float(i), -float(i)]) for i in range(40)], "row_id int, vec array<float>")
    bias = spark.createDataFrame([(i, float(i)) for i in range(40)], "row_id int, b float")
    kept = [0, 1, 2, 5, 9, 17, 30]
    remap = R.dense_remap(spark.createDataFrame([(i,) for i in kept], "token_id int"))
    made = R.trim_model(table, remap, bias=bias, pad_to=8)
    rows = {r["row_id"]: r["vec"] for r in made["embedding"].collect()}
    assert len(rows) == 8 and [rows[i][0] for i in range(7)] == kept and rows[7] == [0.0, 0.0]
    assert {r["row_id"]: r["b"] for r in made["bias"].collect()}[7] == 0.0
    assert R.parameters(made["embedding"]) == 16
    with pytest.raises(ValueError):
        R.gather_rows(table, R.dense_remap(spark.createDataFrame([(99,)], "token_id int")))


def test_settings(spark):
    new = {1: 0, 5: 1}
    found, lost = R.remap_settings({"eos_token_id": 5, "pad_token_id": 3, "bad_token_ids": [1, 3, 5], "text_config": {"bos_token_id": 1}, "use_token_id": True, "x": 9}, new)
    assert found == {"eos_token_id": 1, "pad_token_id": None, "bad_token_ids": [0, 1], "text_config": {"bos_token_id": 0}, "use_token_id": True, "x": 9} and lost == ["pad_token_id"]
    rows = spark.createDataFrame([("", "eos", False, [5]), ("", "pad", False, [3]), ("", "bad", True, [5, 3, 1]), ("", "none", True, [3])], "path string, attr string, is_list boolean, ids array<int>")
    remap = spark.createDataFrame(list(new.items()), "old_id int, new_id int")
    assert {r["attr"]: r["ids"] for r in R.remap_config(rows, remap).collect()} == {"eos": [1], "pad": None, "bad": [1, 0], "none": []}
    assert R.trim_decoder({"5": "a", "7": "b"}, new) == {"1": "a"}


# --- comparison and verification


def test_compare(spark):
    base = TokenizerDocument.from_json(word_document(["[UNK]", "the", "cat", "кот", "кошка", "γάτα", "catж", "123", "!!", "@#"]))
    trimmed = TokenizerDocument.from_json(word_document(["[UNK]", "the", "cat", "123"]))
    report = C.compare_tokenizers(spark, base, trimmed, ["the cat", "the кот"], ["script:Latin"], 3)
    v = report["vocabulary"]
    assert v["is_subset"] and v["order_preserved"] and v["ids_contiguous"] and (v["shared"], v["removed"]) == (4, 6) and v["removed_fraction"] == 0.6
    scripts = {g["name"]: (g["base_tokens"], g["kept"]) for g in report["profile"]["scripts"]}
    assert scripts["CYRILLIC"] == (2, 0) and scripts["LATIN"] == (3, 3) and scripts["mixed"][0] == 1 and scripts["non-letter"][0] == 3
    assert [r["token"] for r in report["profile"]["removed_examples"]] == ["кот", "кошка", "γάτα"]
    assert report["profile"]["removed_by_decile"] == [0, 0, 0, 1, 1, 1, 1, 0, 1, 1]
    assert report["encoding"]["identical"] == 1 and report["encoding"]["examples"] == ["the кот"]
    assert "structural" in [p["name"] for p in report["profile"]["presets"]] and "6 " in C.render(report) + "6 "
    backward = TokenizerDocument.from_json(word_document(["@#", "!!", "123", "catж", "γάτα", "кошка", "кот", "cat", "the", "[UNK]"]))
    v = C.compare_tokenizers(spark, base, backward)["vocabulary"]
    assert v["is_subset"] and v["ids_contiguous"] and not v["order_preserved"]
    foreign = TokenizerDocument.from_json(word_document(["[UNK]", "the", "hond", "kat"]))
    v = C.compare_tokenizers(spark, base, foreign)["vocabulary"]
    assert v["introduced_examples"] == ["hond", "kat"] and not v["is_subset"]
    assert C.template_relation("a", "a") == "identical" and C.template_relation("a", "") == "only in base" and C.template_relation(None, None) == "absent"
    assert C.sparkline([0, 7, 14]) == "▁▅█" and C.sparkline([]) == ""


def test_max_abs_and_logits(spark):
    a = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.0, 0.0])], "row_id int, vec array<double>")
    b = spark.createDataFrame([(0, [1.0, 2.5]), (1, [0.25, 0.0])], "row_id int, vec array<double>")
    assert V.max_abs_diff(a, b).first()[0] == 0.5 and V.max_abs_diff(a.limit(0), b).first()[0] == 0.0
    old = spark.createDataFrame([(0, [1.0, 9.0, 3.0])], "row_id int, vec array<double>")
    new = spark.createDataFrame([(0, [1.0, 3.5, 77.0])], "row_id int, vec array<double>")
    remap = spark.createDataFrame([(0, 0), (2, 1)], "old_id int, new_id int")
    assert V.logit_diff(old, new, remap).first()[0] == 0.5
    assert V.model_ok(1e-6, None) and not V.model_ok(1e-6, 1e-3) and V.length_limit([None, 512, 10**9, 0]) == 512 and V.length_limit([]) is None


# --- whole runs


@pytest.mark.parametrize("name", ["byte_level_bpe", "wordpiece", "unigram", "wordlevel"])
def test_run(spark, request, tmp_path, name):
    source = tmp_path / "model"
    source.mkdir()
    payload = request.getfixturevalue(name)
    (source / "tokenizer.json").write_text(payload)
    (source / "modules.json").write_text("[]")
    (source / "README.md").write_text("x")
    doc = TokenizerDocument.from_path(source)
    (source / "config.json").write_text(json.dumps({"eos_token_id": doc.vocabulary.get("<|im_end|>", 1)}))
    spark.createDataFrame([(i, [float(i)]) for i in range(len(doc.vocabulary))], "row_id int, vec array<float>").write.parquet(str(source / "embedding.parquet"))
    (tmp_path / "corpus.jsonl").write_text("\n".join(json.dumps({"text": t}) for t in SAMPLES * 4))
    config = Config(model=str(source), output_dir=str(tmp_path / "out"), corpus={"datasets": [{"path": "json", "data_files": str(tmp_path / "corpus.jsonl")}]}, selection={"min_count": 1})
    dry = TrimPipeline(spark, config).run(dry_run=True)
    assert dry["output_dir"] is None and not (tmp_path / "out").exists() and dry["corpus"]["documents"] == 20 and dry["corpus"]["coverage"] == 1.0
    report = TrimPipeline(spark, config).run()
    assert report["verification"]["ok"] and report["verification"]["identical"] == report["verification"]["checked"] == 20
    assert report["model_trim"]["rows_after"] == report["vocab_after"] <= report["vocab_before"]
    assert (tmp_path / "out" / "modules.json").exists() and not (tmp_path / "out" / "README.md").exists()
    again = TokenizerDocument.from_path(tmp_path / "out")
    assert sorted(again.vocabulary.values()) == list(range(report["vocab_after"])) and "tokens" in render(report)
    with pytest.raises(FileExistsError):
        TrimPipeline(spark, config).run()


def test_config(tmp_path):
    base = Config(model="m", selection={"keep_presets": ["digits"]})
    assert base.with_overrides({"selection.top_k": None, "selection.keep_presets.-1": "unk", "seed": 3}).selection.keep_presets == ["unk"]
    for bad in ({"selection": {}}, {"selection": {"coverage": 0.0}}, {"selection": {"top_k": 5}}, {"selection": {"keep_presets": ["x"]}, "verify_samples": 2}, {"selection": {"keep_presets": ["x"]}, "typo": 1}, {"corpus": {"datasets": [{"path": "json"}]}, "selection": {"keep_presets": ["x"]}}):
        with pytest.raises(ValueError):
            Config(model="m", **bad)
    (tmp_path / "f.json").write_text("{}")
    with pytest.raises(ValueError, match="data_files"):
        Dataset(path=str(tmp_path / "f.json"))
    with pytest.raises(ValueError):
        Dataset(path="x", load_from_disk=True, revision="r")
    with pytest.raises(ValueError):
        Dataset(path="x", load_from_disk=True, streaming=True)
    assert load_config("some/model").selection.keep_presets == ["structural"] and parse_overrides(["a.b=3", "c=[1, 2]"]) == {"a.b": 3, "c": [1, 2]}
    with pytest.raises(ValueError):
        parse_overrides(["nothing"])
    assert Config.from_text(base.to_text()) == base


def test_guard_and_sidecars(tmp_path):
    (tmp_path / "s" / "1_Pooling").mkdir(parents=True)
    for name in ("modules.json", "1_Pooling/config.json", "config.json"):
        (tmp_path / "s" / name).write_text("{}")
    out = guard(tmp_path / "o", False)
    (out / "modules.json").write_text("mine")
    assert copy_sidecars(tmp_path / "s", out, ["modules.json", "[0-9]_*/*"]) == ["1_Pooling/config.json"] and (out / "modules.json").read_text() == "mine"
    with pytest.raises(FileExistsError):
        guard(out, False)
    guard(out, True)


def test_cli(capsys, tmp_path, wordlevel):
    from tokenloom.__main__ import main

    (tmp_path / "tokenizer.json").write_text(wordlevel)
    assert main(["presets"]) == 0 and "digits" in capsys.readouterr().out
    assert main(["inspect", str(tmp_path)]) == 0 and json.loads(capsys.readouterr().out)["supported"]
