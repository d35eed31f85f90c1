"""Tokenizer documents for tests."""

import json


def added(content, token_id, special=True):
    return {"id": token_id, "content": content, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": special}


def document(model, **parts):
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None} | parts | {"model": model})


def word_document(tokens):
    return document({"type": "WordLevel", "vocab": {t: i for i, t in enumerate(tokens)}, "unk_token": "[UNK]"}, pre_tokenizer={"type": "WhitespaceSplit"})
