"""Operators over whole tokenizer documents, model tables and corpora of a configuration, with equivalent SQL.

The document is a public byte-level BPE one, read where it lies; SQL reads the same file.
"""

from __future__ import annotations

import json
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import text as T
from tokenloom.operators import remap as R
from tokenloom.operators import selection as S
from tokenloom.operators import verify as V
from tokenloom.operators.counting import count_corpus, count_occurrences
from tokenloom.operators.encode import count_tokens, decode, encode, unigram_of
from tokenloom.operators.presets import resolve_preset
from tokenloom.operators.ranking import ranked
from tokenloom.plans.config import Corpus, Dataset, Selecting
from tokenloom.plans.queries import _REMAP, LEX, OTHER, QUERIES, SQL, W, documents, lexicon, query, read, word_rows
from tokenloom.sources.corpus import open_dataset
from tokenloom.sources.scratch import cut
from tokenloom.sources.tokenizer import TokenizerDocument

try:
    import public_tokenizers

    PATH = public_tokenizers.path("byte_bpe_50k.json")
except ModuleNotFoundError:  # the queries on the document then say so when they are called
    PATH = "byte_bpe_50k.json"


@cache
def document() -> TokenizerDocument:
    return TokenizerDocument.from_path(PATH)


RAW = f"raw AS (SELECT content FROM read_text('{PATH}'))"
VOCAB = f"""{RAW},
own AS (SELECT e.key AS token, e.value AS token_id FROM (SELECT unnest(map_entries(from_json(json_extract(content, '$.model.vocab'), '"MAP(VARCHAR,INTEGER)"'))) AS e FROM raw)),
added AS (SELECT a->>'content' AS token, (a->>'id')::INTEGER AS token_id, (a->>'special')::BOOLEAN AS special FROM (SELECT unnest(from_json(json_extract(content, '$.added_tokens'), '["JSON"]')) AS a FROM raw)),
vocab AS (SELECT token, token_id FROM own UNION SELECT token, token_id FROM added)"""
_LETTERS = ", ".join("'" + c.replace("'", "''") + "'" for _, c in sorted(T.byte_letters().items()))
SURFACES = f"""{VOCAB}, letters AS (SELECT unnest([{_LETTERS}]) AS c, unnest(range(256)) AS b),
chars AS (SELECT token, unnest(string_split(token, '')) AS c, unnest(range(length(token))) AS pos FROM vocab),
coded AS (SELECT token, pos, printf('%02X', b) AS h FROM chars LEFT JOIN letters USING (c)),
digits AS (SELECT token, CASE WHEN count(h) = count(*) THEN string_agg(h, '' ORDER BY pos) END AS x FROM coded GROUP BY token),
surfaces AS (SELECT token, try(decode(unhex(x))) AS surface FROM digits),
faced AS (SELECT token, token_id, surface FROM vocab JOIN surfaces USING (token))"""
RULES = f"""{SURFACES},
merges AS (SELECT unnest(ms) AS m, generate_subscripts(ms, 1) - 1 AS rank FROM (SELECT from_json(json_extract(content, '$.model.merges'), '[["VARCHAR"]]') AS ms FROM raw)),
valid AS (SELECT o.token_id AS child, a.token_id AS pl, b.token_id AS pr, rank FROM merges JOIN vocab a ON a.token = m[1] JOIN vocab b ON b.token = m[2] JOIN vocab o ON o.token = m[1] || m[2]),
firsts AS (SELECT child, pl, pr FROM valid QUALIFY row_number() OVER (PARTITION BY child ORDER BY rank) = 1),
deps AS (SELECT child, pl AS parent, 0 AS slot FROM firsts UNION ALL SELECT child, pr, 1 FROM firsts),
structural AS (SELECT token_id FROM added UNION SELECT token_id FROM vocab WHERE token IN (SELECT c FROM letters))"""


@query(f"WITH {SURFACES} SELECT token_id, surface FROM faced")
def token_surfaces(spark, sf_dir):
    """The text that each token of the document stands for, null where it is no whole UTF-8."""
    return document().tables(spark)["vocab"].select("token_id", "surface")


_S = f"regexp_replace(surface, '^[{T.SPACES}]+|[{T.SPACES}]+$', '', 'g')"
_SCRIPT = r"regexp_matches(surface, '\p{{L}}') AND NOT regexp_matches(regexp_replace(surface, '{letters}', '', 'g'), '\p{{L}}')"
_PRESETS = {
    "structural": "token_id IN (SELECT token_id FROM structural)", "added_tokens": "token_id IN (SELECT token_id FROM added)", "special_tokens": "token_id IN (SELECT token_id FROM added WHERE special)",
    "unk": "false", "byte_alphabet": "token IN (SELECT c FROM letters)",
    "single_characters": f"length({_S}) = 1", "ascii_letters": f"regexp_matches({_S}, '^[A-Za-z]+$')", "digits": f"regexp_matches({_S}, '^[0-9]+$')", "alphanumeric": f"regexp_matches({_S}, '^[A-Za-z0-9]+$')",
    "punctuation": rf"regexp_matches({_S}, '^[!-/:-@\[-`{{-~]+$')", "whitespace": f"regexp_matches(surface, '^[{T.SPACES}]+$')", "ascii_printable": r"regexp_matches(surface, '^[\t-\r -~]+$')",
    "script:Latin": _SCRIPT.format(letters=r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{2af}\x{1e00}-\x{1eff}]"), "script:Cyrillic": _SCRIPT.format(letters=r"[\x{400}-\x{52f}]"),
    "script:Greek": _SCRIPT.format(letters=r"[\x{370}-\x{3e1}\x{3f0}-\x{3ff}\x{1f00}-\x{1fff}]"), "script:Hiragana": _SCRIPT.format(letters=r"[\x{3041}-\x{3096}\x{309d}-\x{309f}]"),
}


@query(f"WITH {RULES} " + " UNION ALL ".join(f"SELECT '{name}' AS preset, count(*) AS tokens FROM faced WHERE {rule}" for name, rule in _PRESETS.items()))
def document_presets(spark, sf_dir):
    """How many of the document's tokens each rule names, also those that name none."""
    tables = document().tables(spark)
    named = None
    for name in _PRESETS:
        found = resolve_preset(name, document(), tables).agg(F.count("*").alias("tokens")).select(F.lit(name).alias("preset"), "tokens")
        named = found if named is None else named.unionByName(found)
    return named


@query(f"""
WITH {VOCAB}, of AS (SELECT json_extract_string(content, '$.model.type') AS model, json_extract(content, '$.pre_tokenizer.type') = '"ByteLevel"' AS bytes, json_type(content, '$.post_processor') <> 'NULL' AS post FROM raw)
SELECT 'model_type' AS name, model AS value FROM of UNION ALL SELECT 'uses_byte_level', bytes::VARCHAR FROM of UNION ALL SELECT 'has_post_processor', coalesce(post, false)::VARCHAR FROM of
UNION ALL SELECT 'vocab_size', count(*)::VARCHAR FROM vocab UNION ALL SELECT 'max_token_id', max(token_id)::VARCHAR FROM vocab UNION ALL SELECT 'added_tokens', count(*)::VARCHAR FROM added
UNION ALL SELECT 'special_tokens', (count(*) FILTER (special))::VARCHAR FROM added
""")
def document_profile(spark, sf_dir):
    """The document's own figures."""
    about = document().describe()
    names = ("model_type", "uses_byte_level", "has_post_processor", "vocab_size", "max_token_id", "added_tokens", "special_tokens")
    return spark.createDataFrame([(n, str(about[n]).lower() if isinstance(about[n], bool) else str(about[n])) for n in names], "name string, value string")


@query(f"WITH {RULES} SELECT child, parent, slot FROM deps")
def document_merges(spark, sf_dir):
    """What each merged token of the document is built from."""
    tables = document().tables(spark)
    return S.merge_dependencies(tables["merges"], tables["vocab"])


ASKED = Selecting(keep_presets=["structural", "digits"], keep_tokens=["Ġthe", "nosuch"], keep_token_ids=[1000], keep_patterns=["ing$"], keep_chat_template=False)


@query(f"""
WITH RECURSIVE {RULES}, sources AS (
    SELECT token_id, 'structural' AS reason FROM structural UNION ALL SELECT token_id, 'preset:structural' FROM structural UNION ALL SELECT token_id, 'preset:digits' FROM faced WHERE {_PRESETS['digits']} UNION ALL
    SELECT token_id, 'explicit_token' FROM vocab WHERE token IN ('Ġthe', 'nosuch') UNION ALL SELECT 1000, 'explicit_id' UNION ALL
    SELECT token_id, 'pattern:ing$' FROM faced WHERE regexp_matches(coalesce(nullif(surface, ''), token), 'ing$')),
closed(token_id) AS (SELECT token_id FROM sources UNION SELECT d.parent FROM closed JOIN deps d ON d.child = closed.token_id),
every AS (SELECT * FROM sources UNION ALL SELECT token_id, 'dependency' FROM closed WHERE token_id NOT IN (SELECT token_id FROM sources))
SELECT token_id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM every GROUP BY token_id
""")
def selected_tokens(spark, sf_dir):
    """A whole selection without a corpus: structural and requested tokens, closed over the document's merges."""
    kept = S.select_tokens(document(), document().tables(spark), None, ASKED).kept
    return kept.select("token_id", F.array_join("reasons", ",").alias("reasons"))


_SURVIVORS = f"""{RULES}, kept AS (SELECT token, token_id, row_number() OVER (ORDER BY token_id) - 1 AS new_id FROM vocab WHERE token_id % 7 <> 3 OR token_id IN (SELECT token_id FROM structural)),
left_merges AS (SELECT m[1] || ' ' || m[2] AS value, row_number() OVER (ORDER BY rank) - 1 AS ord FROM merges WHERE m[1] IN (SELECT token FROM kept) AND m[2] IN (SELECT token FROM kept) AND m[1] || m[2] IN (SELECT token FROM kept))"""


def survivors(spark: SparkSession) -> DataFrame:
    """old_id, new_id: all tokens but those of every seventh id that aren't structural."""
    tables = document().tables(spark)
    kept = tables["vocab"].where("token_id % 7 <> 3").select("token_id").union(tables["structural"].select("token_id"))
    return cut(R.dense_remap(kept), "remap")


def trimmed(spark: SparkSession) -> tuple[TokenizerDocument, DataFrame]:
    numbers = survivors(spark)
    new = {r["old_id"]: r["new_id"] for r in numbers.collect()}  # of vocabulary size
    return TokenizerDocument(R.trim_document(document().raw, new)), numbers


@query(f"WITH {_SURVIVORS} SELECT 'token' AS kind, new_id::BIGINT AS ord, token AS value FROM kept WHERE token IN (SELECT token FROM own) UNION ALL SELECT 'added', new_id::BIGINT, token FROM kept WHERE token IN (SELECT token FROM added) UNION ALL SELECT 'merge', ord::BIGINT, value FROM left_merges")
def trimmed_document(spark, sf_dir):
    """The document without every seventh token: its vocabulary, added tokens and merges, renumbered."""
    doc, _ = trimmed(spark)
    rows = [("token", i, t) for t, i in doc.model["vocab"].items()] + [("added", t["id"], t["content"]) for t in doc.added] + [("merge", i, " ".join(m)) for i, m in enumerate(doc.merges)]
    return spark.createDataFrame(rows, "kind string, ord long, value string")


@query(f"WITH {_SURVIVORS} SELECT token_id AS old_id, new_id::INTEGER AS new_id FROM kept")
def remapped_document(spark, sf_dir):
    """The renumbering between the document and its trimmed form, by their tokens alone."""
    doc, _ = trimmed(spark)
    return R.remap_between(document().tables(spark)["vocab"].select("token", "token_id"), doc.tables(spark)["vocab"].select("token", "token_id"))


@query(f"WITH {_SURVIVORS}, rows AS (SELECT token_id, token FROM kept) SELECT token_id, token FROM vocab WHERE token_id NOT IN (SELECT token_id FROM rows)")
def doomed_tokens(spark, sf_dir):
    """What the trim of the document takes away."""
    vocab = document().tables(spark)["vocab"].select("token", "token_id")
    return vocab.join(survivors(spark).select(F.col("old_id").alias("token_id")), "token_id", "left_anti").select("token_id", "token")


@query("""
WITH remap AS (SELECT n_nationkey AS old_id, row_number() OVER (ORDER BY n_nationkey) - 1 AS new_id FROM nation WHERE n_regionkey <= 2),
config AS (SELECT c_mktsegment AS path, c_name AS attr, c_custkey % 2 = 1 AS is_list, CASE WHEN c_custkey % 2 = 1 THEN [c_nationkey, (c_custkey % 25)::INTEGER, (c_custkey % 7)::INTEGER] ELSE [c_nationkey] END AS ids FROM customer),
each AS (SELECT path, attr, is_list, unnest(ids) AS old_id, generate_subscripts(ids, 1) AS pos FROM config)
SELECT path, attr, is_list, CASE WHEN is_list THEN coalesce(string_agg(new_id::VARCHAR, ' ' ORDER BY pos), '') ELSE string_agg(new_id::VARCHAR, ' ' ORDER BY pos) END AS ids
FROM each LEFT JOIN remap USING (old_id) GROUP BY path, attr, is_list
""")
def config_ids(spark, sf_dir):
    """Settings that name ids, renumbered: single ones null where theirs is gone, lists without what is gone."""
    remap = R.dense_remap(read(spark, sf_dir, "nation").where("n_regionkey <= 2").select(F.col("n_nationkey").alias("token_id")))
    odd = F.col("c_custkey") % 2 == 1
    several = F.array("c_nationkey", (F.col("c_custkey") % 25).cast("int"), (F.col("c_custkey") % 7).cast("int"))
    config = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("path"), F.col("c_name").alias("attr"), odd.alias("is_list"), F.when(odd, several).otherwise(F.array("c_nationkey")).alias("ids"))
    return R.remap_config(config, remap).select("path", "attr", "is_list", F.array_join("ids", " ").alias("ids"))


@query(f"""
WITH {_REMAP}, padded AS (SELECT unnest(range(n, ((n + 63) // 64) * 64)) AS row_id FROM size),
vectors AS (SELECT new_id AS row_id, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings JOIN gone ON old_id = vec_id UNION ALL SELECT row_id, unnest(range(64)), 0.0::DOUBLE FROM padded)
SELECT 'embedding' AS name, row_id, pos, x FROM vectors UNION ALL SELECT 'head', row_id, pos, x * 2 FROM vectors
UNION ALL SELECT 'bias', new_id, 0, label::DOUBLE FROM embeddings JOIN gone ON old_id = vec_id UNION ALL SELECT 'bias', row_id, 0, 0.0::DOUBLE FROM padded
""")
def trimmed_tables(spark, sf_dir):
    """Embedding, untied head and bias of the survivors, padded to a multiple of 64."""
    rows = read(spark, sf_dir, "embeddings")
    remap = cut(R.dense_remap(rows.where("label <= 4").select(F.col("vec_id").alias("token_id"))), "remap")
    table = rows.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))
    head = table.withColumn("vec", F.transform("vec", lambda x: (x * 2).cast("float")))
    made = R.trim_model(table, remap, head, rows.select(F.col("vec_id").alias("row_id"), F.col("label").cast("float").alias("b")), 64)
    out = made["bias"].select(F.lit("bias").alias("name"), F.col("row_id").cast("long").alias("row_id"), F.lit(0).cast("long").alias("pos"), F.col("b").cast("double").alias("x"))
    for name in ("embedding", "head"):
        each = made[name].select("row_id", F.posexplode("vec").alias("pos", "x"))
        out = out.unionByName(each.select(F.lit(name).alias("name"), F.col("row_id").cast("long").alias("row_id"), F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x")))
    return out


@query("SELECT sum(len(embedding))::BIGINT AS parameters FROM embeddings")
def table_parameters(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("embedding").alias("vec"))
    return spark.createDataFrame([(R.parameters(rows),)], "parameters long")


@query("""
WITH old AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS id FROM embeddings), kept AS (SELECT * FROM old WHERE id % 3 <> 1)
SELECT max(abs(x::DOUBLE - (x * 1.25::FLOAT)::DOUBLE)) AS max_abs_diff FROM kept
""")
def logit_differences(spark, sf_dir):
    """Old logits against a trimmed model's, over the surviving columns; padding columns of the new ones don't count."""
    old = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))
    remap = cut(R.dense_remap(spark.range(64).where("id % 3 <> 1").select(F.col("id").cast("int").alias("token_id"))), "remap")
    scaled = F.transform(F.filter("vec", lambda x, i: i % 3 != 1), lambda x: (x * F.lit(1.25).cast("float")).cast("float"))
    new = old.select("row_id", F.concat(scaled, F.array(F.lit(9e9).cast("float"))).alias("vec"))
    return V.logit_diff(old, new, remap)


_UNIGRAM = """
letters AS (SELECT DISTINCT unnest(string_split(token, '')) AS c FROM lex),
names AS (SELECT c AS piece, -7 AS score FROM letters UNION ALL SELECT token, CASE WHEN length(token) <= 3 THEN -8 ELSE -10 END FROM lex WHERE n >= 20 AND length(token) >= 2),
pieces AS (SELECT piece, score, row_number() OVER (ORDER BY piece) - 1 AS id FROM names),
starts AS (SELECT token, unnest(range(1, length(token) + 1)) AS place FROM lex WHERE length(token) <= 100),
spans AS (SELECT token, place, unnest(range(1, least(length(token) - place + 1, (SELECT max(length(piece)) FROM pieces)) + 1)) AS len FROM starts),
ends AS (SELECT token, place + len - 1 AS spot, list({'len': len, 'score': score, 'id': id}) AS lasts FROM spans JOIN pieces ON piece = substr(token, place, len) GROUP BY ALL),
reach(token, spot, best) AS (
    SELECT token, 0::BIGINT, [{'score': 0::BIGINT, 'len': 0::BIGINT, 'id': -1::BIGINT}] FROM lex WHERE length(token) <= 100 UNION ALL
    SELECT r.token, e.spot, list_append(r.best, list_max(list_transform(e.lasts, lambda c: {'score': (r.best[e.spot - c.len + 1]).score + c.score, 'len': c.len, 'id': c.id}))) FROM reach r JOIN ends e ON e.token = r.token AND e.spot = r.spot + 1),
back(token, spot, best, ids) AS (
    SELECT token, spot, best, ''::VARCHAR FROM reach WHERE spot = length(token) UNION ALL
    SELECT token, spot - (best[spot + 1]).len, best, (best[spot + 1]).id || ' ' || ids FROM back WHERE spot > 0)"""


@query(f"WITH RECURSIVE {LEX}, {_UNIGRAM} SELECT l.token, coalesce(trim(b.ids), '-1') AS ids FROM lex l LEFT JOIN back b ON b.token = l.token AND b.spot = 0")
def encode_unigram_words(spark, sf_dir):
    """Distinct words by a Unigram vocabulary of all letters and frequent words."""
    base = lexicon(spark, sf_dir)
    letters = base.select(F.explode(F.split("token", "")).alias("token")).where("token <> ''").distinct().withColumn("score", F.lit(-7.0))
    common = base.where((F.col("n") >= 20) & (F.length("token") >= 2)).select("token", F.when(F.length("token") <= 3, -8.0).otherwise(-10.0).alias("score"))
    pieces = cut(ranked(letters.unionByName(common), [F.asc("token")]).select("token", "score", (F.col("rk") - 1).cast("int").alias("token_id")), "pieces")
    return unigram_of(base.select("token"), pieces, -1).select("token", F.array_join("ids", " ").alias("ids"))


WORDS_KEPT = 3000


def word_document(spark: SparkSession, sf_dir: str) -> str:
    """A word-level document of the most frequent words: WORDS_KEPT at most, so it may be gathered."""
    counts = count_occurrences(word_rows(documents(spark, sf_dir)))
    tokens = [r["token"] for r in S.cut_by_corpus(counts, top_k=WORDS_KEPT, key="token").orderBy("rk").select("token").collect()]
    vocab = {t: i for i, t in enumerate(["[UNK]", *tokens])}
    parts = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None}
    return json.dumps(parts | {"model": {"type": "WordLevel", "vocab": vocab, "unk_token": "[UNK]"}})


_SPLIT = f"regexp_extract_all(lower(text), '[^{T.SPACES}]+')"
_WORD_VOCAB = f"{LEX}, known AS (SELECT token, token_id + 1 AS id FROM lex WHERE token_id < {WORDS_KEPT})"


@query(f"WITH {_WORD_VOCAB}, found AS (SELECT unnest({_SPLIT}) AS token FROM docs) SELECT coalesce(id, 0)::INTEGER AS token_id, count(*) AS n FROM found LEFT JOIN known USING (token) GROUP BY ALL")
def encode_document_counts(spark, sf_dir):
    """Token counts of the documents by a whole tokenizer document, summed in the encoder's batches."""
    return count_tokens(documents(spark, sf_dir), word_document(spark, sf_dir)).groupBy("token_id").agg(F.sum("n").alias("n"))


@query(f"""
WITH {_WORD_VOCAB}, given AS (SELECT 0 AS ds, doc_id AS id, text, 0.5::DOUBLE AS weight FROM documents UNION ALL SELECT 1, item_id, text, 3.0::DOUBLE FROM benchmark),
found AS (SELECT ds, g.id, weight, unnest({_SPLIT}) AS token FROM given g WHERE text <> ''),
each AS (SELECT coalesce(k.id, 0) AS token_id, round_even(count(*) * first(weight), 0)::BIGINT AS w FROM found f LEFT JOIN known k USING (token) GROUP BY ds, f.id, k.id)
SELECT token_id::INTEGER AS token_id, sum(w)::BIGINT AS n FROM each GROUP BY token_id
""")
def counted_corpora(spark, sf_dir):
    """Two datasets of a configuration, read by their loader and weighing 0.5 and 3, counted by a tokenizer document."""
    several = [Dataset(path="parquet", data_files=f"{sf_dir}/documents.parquet", weight=0.5), Dataset(path="parquet", data_dir=sf_dir, data_files=["benchmark.parquet"], weight=3.0)]
    return count_corpus(spark, word_document(spark, sf_dir), Corpus(datasets=several)).counts.select("token_id", F.col("n").cast("long").alias("n"))


@query(f"WITH {_WORD_VOCAB}, found AS (SELECT item_id, unnest({_SPLIT}) AS token, unnest(range(len({_SPLIT}))) AS pos FROM benchmark) SELECT item_id, string_agg(coalesce(k.token, '[UNK]'), ' ' ORDER BY pos) AS text FROM found LEFT JOIN known k USING (token) GROUP BY item_id")
def decoded_texts(spark, sf_dir):
    """The benchmark's texts encoded and decoded again by a word-level document."""
    payload = word_document(spark, sf_dir)
    return decode(encode(read(spark, sf_dir, "benchmark"), payload, ["item_id"]), payload, ["item_id"])


@query("""
WITH placed AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row, count(*) OVER () AS n FROM documents)
SELECT doc_id FROM placed WHERE row >= round(n * 10 / 100.0) AND row < round(n * 25 / 100.0) UNION ALL SELECT doc_id FROM placed WHERE row >= n - 7
""")
def split_slices(spark, sf_dir):
    """A dataset's slice from a tenth to a quarter, and its last seven rows (the file is in order of doc_id)."""
    return open_dataset(spark, Dataset(path="parquet", split="train[10%:25%]+train[-7:]", data_files=f"{sf_dir}/documents.parquet")).select("doc_id")


@query(f"""
WITH {OTHER}, items AS (SELECT item_id, text, unnest(regexp_extract_all(lower(text), '{W}')) AS token FROM benchmark),
lost AS (SELECT item_id, first(text) AS text FROM items LEFT JOIN other o USING (token) GROUP BY item_id HAVING count(*) > count(o.token))
SELECT substr(text, 1, 200) AS text FROM lost ORDER BY item_id LIMIT 5
""")
def first_failures(spark, sf_dir):
    """The first texts of the benchmark that the English lexicon doesn't bring back."""
    from tokenloom.plans.queries import english, word_counts

    each = read(spark, sf_dir, "benchmark").select("item_id", "text", F.posexplode(T.words(F.col("text"))).alias("pos", "token"))
    known = english(word_counts(spark, sf_dir)).withColumn("back", F.col("token"))
    rows = each.join(known, "token", "left").groupBy("item_id").agg(F.first("text").alias("text"), F.array_sort(F.collect_list(F.struct("pos", "token", F.coalesce("back", F.lit("[UNK]")).alias("back")))).alias("v"))
    join = lambda name: F.array_join(F.transform("v", lambda x: x[name]), " ")
    judged = V.verdicts(rows.select("item_id", "text", join("token").alias("old_text"), join("back").alias("new_text"), F.lit(None).cast("array<int>").alias("mapped"), F.array(F.lit(0)).alias("new_ids")))
    return V.failures(judged, "item_id")


__all__ = ["QUERIES", "SQL"]
