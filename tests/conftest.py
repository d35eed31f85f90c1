import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import added, document


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


@pytest.fixture(scope="session")
def byte_level_bpe():
    from tokenloom.functions.text import byte_alphabet

    merges = ["Ġ d", "Ġd e", "h e", "t he", "Ġ t", "Ġt he", "a t", "Ġ a", "Ġa t"]
    tokens = [*byte_alphabet(), *[m.replace(" ", "") for m in merges], "<|endoftext|>", "<|im_start|>", "<|im_end|>"]
    vocab = {t: i for i, t in enumerate(tokens)}
    end = vocab["<|im_end|>"]
    post = {"type": "TemplateProcessing", "single": [{"Sequence": {"id": "A", "type_id": 0}}, {"SpecialToken": {"id": "<|im_end|>", "type_id": 0}}], "pair": [{"Sequence": {"id": "A", "type_id": 0}}, {"Sequence": {"id": "B", "type_id": 0}}], "special_tokens": {"<|im_end|>": {"id": "<|im_end|>", "ids": [end], "tokens": ["<|im_end|>"]}}}
    special = [added(t, vocab[t]) for t in tokens[-3:]]
    own = {t: i for t, i in vocab.items() if not t.startswith("<|")}
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": own, "merges": merges}
    return document(model, added_tokens=special, pre_tokenizer=BYTE_LEVEL, decoder=BYTE_LEVEL, post_processor=post)


@pytest.fixture(scope="session")
def wordpiece():
    tokens = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", *"abcdefghijklmnopqrstuvwxyz", "the", "cat", "sat", "##ing", "##ed", "run", "dog", "##s"]
    vocab = {t: i for i, t in enumerate(tokens)}
    special = [added(t, vocab[t]) for t in tokens[:5]]
    model = {"type": "WordPiece", "unk_token": "[UNK]", "continuing_subword_prefix": "##", "max_input_chars_per_word": 64, "vocab": vocab}
    post = {"type": "BertProcessing", "sep": ["[SEP]", 3], "cls": ["[CLS]", 2]}
    return document(model, added_tokens=special, pre_tokenizer={"type": "Whitespace"}, post_processor=post, decoder={"type": "WordPiece", "prefix": "##", "cleanup": True})


@pytest.fixture(scope="session")
def unigram():
    pieces = [["▁the", -1.0], ["▁cat", -2.0], ["<unk>", 0.0], *[[p, -3.0] for p in ("▁dog", "▁sat", "▁ran", "▁hat")], *[[c, -6.0] for c in "abcdefghijklmnopqrstuvwxyz▁"]]
    meta = {"type": "Metaspace", "replacement": "▁", "prepend_scheme": "always", "split": True}
    return document({"type": "Unigram", "unk_id": 2, "vocab": pieces, "byte_fallback": False}, pre_tokenizer=meta, decoder=meta)


@pytest.fixture(scope="session")
def wordlevel():
    tokens = ["[UNK]", "the", "cat", "sat", "on", "mat", "dog", "ran", "fast"]
    return document({"type": "WordLevel", "vocab": {t: i for i, t in enumerate(tokens)}, "unk_token": "[UNK]"}, pre_tokenizer={"type": "Whitespace"})
