"""The whole pipeline against brute force on a small fixture."""

import collections
import hashlib
import random

import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from tokenloom.llm import alignment, bpe, mixing, near_dedup, quality  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(21)
    at = tmp_path_factory.mktemp("tables")
    word = lambda: f"w{r.randrange(4000)}"
    good = lambda: "\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(r.randrange(3, 9)))
    rows = []
    for _ in range(90):
        kind, source = r.random(), r.choice(["a", "b", "c", None])
        if kind < 0.15:
            text = "\n".join(" | ".join(word() for _ in range(9)) for _ in range(5))
        elif kind < 0.2:
            text = "too short"
        elif kind < 0.3 and rows:
            text = r.choice(rows)[1]
        elif kind < 0.45 and rows and len((t := r.choice(rows)[1] or "").split()) > 60:
            words = t.split(" ")
            words[r.randrange(len(words))] = "changed"
            text = " ".join(words)
        else:
            text = good()
        rows.append((len(rows), text, "en", source, len(text)))
    rows += [(90, None, None, None, None), (None, good(), "en", "a", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(" | " not in t), 0) for i, t, *_ in rows[:60]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), rows


def test_pipeline(spark, folder):
    import tiktoken

    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    chain = quality.fit_on(docs, spark.read.parquet(f"{at}/labels.parquet"))
    good = {(f["doc_id"]) for f in quality.judge(docs, chain).collect() if f["kept"]}
    assert all((i in good) == (t is not None and " | " not in t and t != "too short") for i, t, *_ in rows)
    latest = {}
    for i, t, *_ in rows:
        if i in good:
            latest[t] = max((x for x in (i, latest.get(t)) if x is not None), default=None)
    kept = {i: t for t, i in latest.items()}
    words = {i: near_dedup.words_of(t.encode()) for i, t in kept.items()}
    root = {i: i for i in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(kept)
    for x in range(len(ids)):
        for y in range(x):
            a, b = words[ids[x]], words[ids[y]]
            if alignment.within(a, b, int(0.2 * max(len(a), len(b)) + 1e-9)):
                root[find(ids[x])] = find(ids[y])
    classes = collections.defaultdict(list)
    for i in ids:
        classes[find(i)].append(i)
    left = {min(c, key=lambda i: (i is None, i or 0)) for c in classes.values()}

    docs_now = docs
    for name, stage in pipeline.STAGES[:3]:
        docs_now = stage(spark, docs_now, at)
    assert {r["doc_id"] for r in docs_now.collect()} == left and docs_now.columns == docs.columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs_now).collect() if r["copies"]}
    path, source = bpe.public_vocabulary()
    model = tiktoken.Encoding("own", pat_str=source, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    found = pipeline.run(spark, at).collect()
    assert collections.Counter(r["doc_id"] for r in found) == copies
    for r in found:
        ids = np.array(model.encode_ordinary(kept[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(kept[r["doc_id"]].encode()).hexdigest() and r["whole"]


def test_pipeline_of_nothing(spark, folder, tmp_path):
    at, _ = folder
    for name in ("documents", "labels"):
        spark.read.parquet(f"{at}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_line_in_common_doesnt_hold_up_the_stages_after_near_dedup(spark, tmp_path, monkeypatch):
    """Rows that near dedup aligns or compares, of texts that aren't near-duplicates, follow their number; source mix then gets all of them."""
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", 10)
    seen = []
    for name in ("link_blocks", "meetings"):
        own = getattr(near_dedup, name, None)
        monkeypatch.setattr(near_dedup, name, lambda table, own=own: (seen.append(table.count()), own(table))[1], raising=False)
    r = random.Random(27)
    line = " ".join(f"common{k}" for k in range(12))
    own = lambda: " ".join(f"w{r.randrange(4000)}" for _ in range(6))
    docs = spark.createDataFrame([(i, f"{own()}\n{line}\n{own()}", "a") for i in range(400)], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    for name, stage in pipeline.STAGES[2:4]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.select("doc_id").distinct().count() == 400
    assert 400 < sum(seen) < 20 * 400, seen
