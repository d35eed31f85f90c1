import importlib.util
import json
import logging
import os
import random

import pytest
from helpers import document, word_document
from pyspark.sql import functions as F

import tokenloom
from tokenloom.operators import remap as R
from tokenloom.operators import selection as S
from tokenloom.operators.counting import Counts
from tokenloom.operators.encode import unigram_of
from tokenloom.operators.ranking import ranked
from tokenloom.plans.config import Config, Corpus, Dataset
from tokenloom.sources.backends import Backend, get_backend, register_backend, supported_model_types
from tokenloom.sources.corpus import open_dataset, parse_split, sample
from tokenloom.sources.tokenizer import TokenizerDocument


def column(df, name):
    return sorted(r[name] for r in df.select(name).collect())


def test_unigram_equals_the_library(spark):
    from tokenizers import Tokenizer

    r = random.Random(4)
    pieces = [["<unk>", 0.0], *[[c, -float(r.randrange(60, 90)) / 8] for c in "abcdef"], *[["".join(r.choice("abcdef") for _ in range(n)), -r.random() * 12] for n in (2, 3, 4) for _ in range(25)]]
    pieces = [[p, s + i * 1e-6] for i, (p, s) in enumerate({p: s for p, s in pieces}.items())]
    model = Tokenizer.from_str(document({"type": "Unigram", "unk_id": 0, "vocab": pieces, "byte_fallback": False}))
    words = ["", "a", "zz", "azzb", "zazz"] + ["".join(r.choice("abcdef" * 4 + "z") for _ in range(r.randrange(1, 14))) for _ in range(150)]
    table = spark.createDataFrame([(p, i, s) for i, (p, s) in enumerate(pieces) if i], "token string, token_id int, score double")
    found = {r["token"]: r["ids"] for r in unigram_of(spark.createDataFrame([(w,) for w in set(words)], "token string"), table, 0).collect()}
    assert found == {w: model.encode(w, add_special_tokens=False).ids for w in set(words)}


def test_closure_of_long_chains_and_cycles(spark):
    deps = {c: (c - 1, c // 2) for c in range(1, 24)} | {30: (31,), 31: (30,)}
    table = spark.createDataFrame([(c, p, i) for c, ps in deps.items() for i, p in enumerate(ps)], "child int, parent int, slot int")
    assert column(S.expand_dependencies(spark.createDataFrame([(23,), (30,)], "token_id int"), table), "token_id") == [*range(23), 31]
    assert S.expand_dependencies(spark.createDataFrame([(0,)], "token_id int"), table).count() == 0


def test_ranking_knows_the_total(spark):
    rows = spark.createDataFrame([(i, i % 7) for i in range(100)], "k int, n int")
    found = ranked(rows, [F.desc("n"), F.asc("k")], total_of="n").orderBy("rk").collect()
    assert {r["total"] for r in found} == {sum(i % 7 for i in range(100))} and [r["rk"] for r in found] == list(range(1, 101))
    assert all(b["before"] == a["before"] + a["n"] for a, b in zip(found, found[1:]))


def test_scratch_tables_are_cleared_but_for_the_newest(spark):
    from tokenloom.sources.scratch import clear, cut, cut_counted, made

    since = made()
    first = cut(spark.range(5))
    second, n = cut_counted(first.where("id > 1"))
    clear(spark, since)
    assert n == 3 and second.count() == 3 and made() == since + 1
    with pytest.raises(Exception, match="exist|NOT_FOUND"):
        spark.read.parquet(first.inputFiles()[0]).count()


def test_order_along_range_partitions(spark):
    from tokenloom.operators.compare import order_preserved

    pairs = [(i, 2 * i) for i in range(500)]
    kept = lambda rows: order_preserved(spark.createDataFrame(rows, "b int, o int").repartition(5)).first()[0]
    assert kept(pairs) and kept(pairs[:1]) and order_preserved(spark.createDataFrame([], "b int, o int")).first()[0]
    for i in (0, 124, 250, 498):
        assert not kept([*pairs[:i], (i, 2 * i + 2), (i + 1, 2 * i), *pairs[i + 2 :]])


def test_split_expressions(spark, tmp_path):
    spark.range(40).withColumn("text", F.col("id").cast("string")).coalesce(1).write.parquet(str(tmp_path / "d"))
    read = lambda split: column(open_dataset(spark, Dataset(path="parquet", split=split, data_files=str(tmp_path / "d"))), "id")
    assert read("train[:10%]") == [0, 1, 2, 3] and read("train[38:]") == [38, 39] and read("train[-3:-1]") == [37, 38] and read("train") == list(range(40))
    assert read("train[:1]+train[5:6]") == [0, 5] and parse_split("a+b[1:]") == [("a", None, None), ("b", "1", None)]
    with pytest.raises(ValueError, match="split"):
        parse_split("train[1")


def test_folders_of_several_kinds_are_read_whole(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "one", "x": 1}\n')
    (tmp_path / "b.txt").write_text("two\nthree\n")
    (tmp_path / "c.csv").write_text("text\nfour\n")
    (tmp_path / "_SUCCESS").write_text("")
    assert column(open_dataset(spark, Dataset(path=str(tmp_path))), "text") == ["four", "one", "three", "two"]
    assert open_dataset(spark, Dataset(path=f"file://{tmp_path}")).count() == 4
    with pytest.raises(FileNotFoundError):
        open_dataset(spark, Dataset(path=str(tmp_path / "nothing")))


def test_arrow_files_of_both_kinds(spark, tmp_path):
    import pyarrow as pa

    table = pa.table({"text": ["a", "b", None], "n": pa.array([1, 2, 3], pa.int32())})
    for name, kind in (("data-0.arrow", pa.ipc.new_stream), ("data-1.arrow", pa.ipc.new_file)):
        with pa.OSFile(str(tmp_path / name), "wb") as f, kind(f, table.schema) as w:
            w.write_table(table)
    rows = open_dataset(spark, Dataset(path=str(tmp_path), load_from_disk=True))
    assert rows.dtypes == [("text", "string"), ("n", "int")] and column(rows, "n") == [1, 1, 2, 2, 3, 3]


def test_a_seed_fixes_the_sample_whatever_the_partitions(spark):
    docs = spark.createDataFrame([(f"t{i % 30}",) for i in range(200)], "text string")
    one, two, other = (column(sample(d, 20, s), "text") for d, s in ((docs, 3), (docs.repartition(7), 3), (docs, 4)))
    assert one == two != other and len(one) == 20
    same = spark.createDataFrame([("x",)] * 50, "text string")
    assert sample(same, 9, 1).count() == 9


def test_numbers_both_ways_and_padding(spark, caplog):
    remap = spark.createDataFrame([(2, 0), (5, 1)], "old_id int, new_id int")
    ids = spark.createDataFrame([(5,), (9,)], "token_id int")
    assert {r["token_id"]: r["new_id"] for r in R.to_new(ids, remap).collect()} == {5: 1, 9: None} and column(R.surviving(ids, remap), "token_id") == [5]
    assert {r["token_id"]: r["old_id"] for r in R.to_old(spark.createDataFrame([(0,), (3,)], "token_id int"), remap).collect()} == {0: 2, 3: None}
    assert R.padding_after(5, remap) == 1 and R.padding_after(None, remap) is None
    with caplog.at_level(logging.WARNING):
        assert R.padding_after(9, remap) is None
    assert "padding row 9" in caplog.text
    table = spark.createDataFrame([(2, [1.0]), (6, [2.0])], "row_id int, vec array<double>")
    with pytest.raises(ValueError, match="id 5"):  # a gap within the table, not only beyond its end
        R.gather_rows(table, remap)


def test_backends(spark):
    assert {"BPE", "Unigram", "WordLevel", "WordPiece"} <= set(supported_model_types())
    with pytest.raises(ValueError, match="already"):
        register_backend("BPE")(Backend)
    with pytest.raises(KeyError, match="Own"):
        get_backend("Own")

    @register_backend("Own")
    class Own(Backend):
        def structural(self, document):
            return {"the", "not there"}

    try:
        doc = TokenizerDocument.from_json(document({"type": "Own", "vocab": {"the": 0, "cat": 1}}))
        assert doc.structural == {"the"} and S.select_tokens(doc, doc.tables(spark), None, Config.of_model("m").selection).ids() == [0]
    finally:
        from tokenloom.sources import backends

        del backends._families["Own"]


def test_counts_as_tables(spark, tmp_path):
    counts = Counts(spark.createDataFrame([(1, 10), (2, 5)], "token_id int, n long"), 15, 3, ["x", "y"])
    counts.save(str(tmp_path / "kept"))
    again = Counts.load(spark, str(tmp_path / "kept"))
    assert again.to_dict() == counts.to_dict() and again.samples == ["x", "y"]


def test_settings_without_effect_are_named(caplog):
    with caplog.at_level(logging.WARNING):
        Config(model="m", revision="v1", corpus=Corpus(datasets=[Dataset(path="json", data_files="x", name="n")]), selection={"top_k": 3})
    assert "revision" in caplog.text and "datasets.0.name" in caplog.text


def test_public_names_and_messages(capsys):
    for name in tokenloom.__all__:
        assert getattr(tokenloom, name) is not None
    with pytest.raises(AttributeError):
        tokenloom.nothing
    own = tokenloom.show_messages("INFO")
    assert len(tokenloom.show_messages("INFO").handlers) == 1
    own.info("hello")
    assert "hello" in capsys.readouterr().err
    with pytest.raises(tokenloom.MissingDependencyError, match="frobnitz"):
        from tokenloom.errors import needed

        needed("frobnitz", "this test")


def test_examples_run(spark, tmp_path, byte_level_bpe):
    folder = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "examples")

    def run(name, *args):
        spec = importlib.util.spec_from_file_location(name, f"{folder}/{name}.py")
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        return module.main(spark, *map(str, args))

    model = tmp_path / "model"
    model.mkdir()
    (model / "tokenizer.json").write_text(byte_level_bpe)
    spark.createDataFrame([("the cat sat",), ("at the dog",)] * 4, "text string").coalesce(1).write.parquet(str(tmp_path / "corpus"))
    assert run("inspect_document", model)["digits"] == 10
    assert run("trim_by_rules", model, tmp_path / "rules")["vocab_after"] > 259
    report = run("trim_by_corpus", model, tmp_path / "corpus", tmp_path / "out")
    assert report["verification"]["ok"] and json.loads((tmp_path / "out" / "trim_report.json").read_text())["vocab_after"] == report["vocab_after"]
    assert spark.read.parquet(str(tmp_path / "out" / "vocab.parquet")).count() == report["vocab_after"]
    assert run("own_preset", model).count() == 7
    assert run("step_by_step", model, tmp_path / "corpus").count() >= 259
    assert run("local_corpus", model, tmp_path / "corpus", tmp_path / "cache").documents == 4 and (tmp_path / "cache" / "counts").exists()
    (tmp_path / "w.json").write_text(word_document(["[UNK]", "the", "cat"]))
    assert run("compare_documents", tmp_path / "w.json", tmp_path / "w.json")["vocabulary"]["removed"] == 0


def test_slices_follow_files_not_partitions(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = [{"id": i, "text": "x" * (10 if i < 40 else 400)} for i in range(90)]
    cuts = [(0, 40), (40, 50), (50, 90)]  # the later files are larger, so Spark reads them first
    for kind in ("parquet", "json", "csv", "arrow"):
        (tmp_path / kind).mkdir()
    for k, (a, b) in enumerate(cuts):
        table = pa.Table.from_pylist(rows[a:b])
        pq.write_table(table, tmp_path / "parquet" / f"{k}.parquet", row_group_size=7, compression=None)
        (tmp_path / "json" / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in rows[a:b]))
        (tmp_path / "csv" / f"{k}.csv").write_text("id,text\n" + "".join(f"{r['id']},{r['text']}\n" for r in rows[a:b]))
        with pa.OSFile(str(tmp_path / "arrow" / f"{k}.arrow"), "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
            w.write_table(table)
    wanted = [*range(9, 42), *range(83, 90)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for most in ("2k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            for kind in ("parquet", "json", "csv", "arrow"):
                found = open_dataset(spark, Dataset(path=str(tmp_path / kind), split="train[10%:42]+train[-7:]"))
                assert column(found.withColumn("id", F.col("id").cast("int")), "id") == wanted, (kind, most)
            for kind in ("parquet", "json", "csv"):  # files that are named come in the order given
                files = [str(tmp_path / kind / f"{k}.{kind}") for k in (2, 0, 1)]
                found = open_dataset(spark, Dataset(path=kind, split="train[38:42]+train[-1:]", data_files=files))
                assert column(found.withColumn("id", F.col("id").cast("int")), "id") == [0, 1, 49, 88, 89]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_frequent_words_are_not_one_task(spark, monkeypatch):
    from tokenloom.operators import encode as E
    from tokenloom.sources import scratch

    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 2)
    lines = {i: "the " * 20 + ("odd " if i % 2 else "new ") * 15 + f"w{i} rare{i} rare{i}" for i in range(200)}
    docs = spark.createDataFrame(list(lines.items()), "doc_id long, text string").repartition(4)
    ids = {w: k for k, w in enumerate(["the", "odd", *[f"rare{i}" for i in range(0, 200, 2)]])}
    vocab = spark.createDataFrame(list(ids.items()), "token string, token_id int")
    coded = E.encode_wordlevel(docs, vocab, unk=-1)
    wanted = sorted((i, k, w, ids.get(w, -1)) for i, line in lines.items() for k, w in enumerate(line.split()))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = coded.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert sorted(tuple(r)[:4] for r in found) == wanted
    of_the = [r["task"] for r in found if r["token"] == "the"]
    assert max(of_the.count(k) for k in set(of_the)) < 0.5 * len(of_the)  # all of them before
    by_text = {i: [ids.get(w, -1) for w in line.split()] for i, line in lines.items()}
    for hot in (None, vocab.where("token_id < 2")):
        sums = E.sum_wordlevel(docs, vocab, hot=hot).collect()
        assert {r["doc_id"]: tuple(r)[1:] for r in sums} == {i: (len(x), x.count(-1), sum(x)) for i, x in by_text.items()}


def test_whole_weights_are_counted_before_the_shuffle(spark):
    from tokenloom.operators.counting import count_weighted

    rows = [(d, w, t) for d in range(300) for w in (2.0, 0.5, 1.5) for t in ("a", "a", "a", "b")]
    rows += [(None, 2.0, "a"), (None, 0.5, "c"), (7, None, "b")]
    tokens = spark.createDataFrame(rows, "doc long, weight double, token string")
    found = {}
    tasks = tokens.rdd.getNumPartitions()
    for weights in (["2.0"], ["0.5", "1.5"]):
        part = count_weighted(tokens.where(f"weight IN ({', '.join(weights)})"), ["doc", "weight"], "weight")
        found |= {(r["token"], *weights): r["n"] for r in part.collect()}
        plan = part._jdf.queryExecution().executedPlan()
        most = max(_rows_shuffled(plan))
        assert (most <= 2 * tasks) if weights == ["2.0"] else (most >= 1200)  # a row a task and token, or a document and token
    assert found == {("a", "2.0"): 1802, ("b", "2.0"): 600, ("a", "0.5", "1.5"): 300 * (2 + 4), ("b", "0.5", "1.5"): 300 * (0 + 2), ("c", "0.5", "1.5"): 0}
    assert {r["token"]: r["n"] for r in count_weighted(tokens, ["doc", "weight"], "weight").collect()} == {"a": 1802 + 1800, "b": 600 + 600, "c": 0}


def _rows_shuffled(plan):
    """Rows written by each exchange of a plan that has run."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        yield from _rows_shuffled(plan.executedPlan())
        return
    if name.endswith("QueryStage"):
        yield from _rows_shuffled(plan.plan())
    if name == "Exchange" and plan.metrics().contains("shuffleRecordsWritten"):
        yield plan.metrics().apply("shuffleRecordsWritten").value()
    children = plan.children()
    for i in range(children.size()):
        yield from _rows_shuffled(children.apply(i))


def test_only_frequent_words_are_ranked_for_merges(spark, tmp_path, monkeypatch):
    from tokenloom.plans import queries as Q

    lines = [" ".join(["went", "sing", "sing", f"rare{i}"]) for i in range(Q.LEAST)]
    spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    monkeypatch.setattr(Q, "numbered", lambda counts, own=Q.numbered: seen.append(counts.count()) or own(counts))
    closed = Q.dependency_closure(spark, str(tmp_path)).count()
    assert seen == [2] and closed == len({"w", "we", "wen", "e", "n", "t", "s", "si", "sin", "i", "g"})


def test_bpe_counts_encode_each_piece_once(byte_level_bpe, monkeypatch):
    import pyarrow as pa

    from tokenloom.operators import encode as E

    r = random.Random(5)
    parts = ["the", "at", "de", "hé", "1", "'s", "<|im_end|>", "!", " ", "  ", "\n", " \n", "\t", " ", " ", "\x1c", "\x85", " the", "the "]
    lines = ["", " ", "the  at", *["".join(r.choice(parts) for _ in range(r.randrange(1, 12))) for _ in range(400)], *["the at the at de at"] * 300]
    batch = pa.RecordBatch.from_arrays([pa.array(lines)], names=["text"])
    wanted, given, own = {}, [], E._ids
    for ids in own(byte_level_bpe, lines):
        for i in ids:
            wanted[i] = wanted.get(i, 0) + 1
    monkeypatch.setattr(E, "_ids", lambda document, texts: given.extend(texts) or own(document, texts))
    assert E.cut_at_spaces(byte_level_bpe)
    found = list(E._count_pieces(byte_level_bpe, iter([batch])))
    assert dict(zip(found[0]["token_id"].to_pylist(), found[0]["n"].to_pylist())) == wanted and len(found) == 1
    assert given.count(" at") == 1 and "the at the at de at" not in given
    changed = json.loads(byte_level_bpe)
    for name, value in (("normalizer", {"type": "Lowercase"}), ("truncation", {"max_length": 4}), ("pre_tokenizer", {"type": "Whitespace"})):
        assert not E.cut_at_spaces(json.dumps(changed | {name: value}))
