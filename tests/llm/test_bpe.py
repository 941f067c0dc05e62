import hashlib
import json
import random

import numpy as np
import pytest

from rulesieve.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
PIECES = ["th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "a", "e", "i", "o", "u", "n", "t", "s"]
POOL = "abcdefghijklmnopqrstuvwxyzABCΣσςİIıẞß'’0123456789 \n\t  !?.,;-_<>|éêñüøåłçÀ中文字テスト한국어🙂²½Ⅷ٠\x1c\x85​﻿\x00\x7f"
FIXED = ["", "a" * 3000, "ab" * 2000, "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|>", "ΑΣ ΑΣ. ΣΑ", "it's we'll I'VE don't", "é́̂" * 40, "ha" * 700 + "!!!!", " ", "  x"]


@pytest.fixture(scope="module")
def both():
    path = bpe.vocabulary_path()
    theirs = tokenizers.Tokenizer.from_file(path)
    theirs.no_truncation()
    theirs.no_padding()
    with open(path, "rb") as f:
        return bpe.Bpe(f.read()), theirs


def test_same_ids_and_texts_as_the_library(both):
    own, theirs = both
    rnd = random.Random(11)
    texts = FIXED + ["".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 60))) for _ in range(3000)] + ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 14))) for _ in range(8000)]
    for text in texts:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text[:80]
        assert own.decode(ids) == theirs.decode(ids, skip_special_tokens=False)
    assert own.decode([1, 10**6]) == theirs.decode([1], skip_special_tokens=False)


def test_added_tokens_of_another_file(both):
    own, _ = both
    with open(bpe.vocabulary_path(), "rb") as f:
        file = json.load(f)
    file["added_tokens"] = [{**file["added_tokens"][0], "content": "[PAD]"}, {**file["added_tokens"][0], "content": "[PAD]x", "id": 49407}]
    theirs = tokenizers.Tokenizer.from_str(json.dumps(file))
    theirs.no_truncation()
    theirs.no_padding()
    other = bpe.Bpe(json.dumps(file).encode())
    for text in ("a [PAD]b[PAD]x c", "[PAD]", "<|endoftext|>"):
        assert other.encode(text) == theirs.encode(text, add_special_tokens=False).ids
    file["added_tokens"][0]["lstrip"] = True
    with pytest.raises(ValueError):
        bpe.Bpe(json.dumps(file).encode())


def test_a_prefix_has_one_last_token(both):
    own, _ = both
    word = "thereforetheintheretic"
    for n in range(1, len(word) + 1):
        ids = own.encode_word(word[:n])
        assert all(own.fits(a, b) for a, b in zip(ids, ids[1:], strict=False))


def test_query(both, docs):
    own, theirs = both
    rows = [(1, "Hello  World's"), (2, None), (3, ""), (4, "Hello  World's"), (None, "x"), (5, "long " * 30000)]
    got = {(r["doc_id"], r["n_tokens"]): r for r in bpe.query(docs(rows)).collect()}
    assert len(got) == 6
    for doc, text in rows:
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        r = got[doc, len(ids)]
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.query(docs([])).collect() == []
    assert bpe.encode(docs([(1, "a b")]), bpe.vocabulary_path()).first()["ids"] == theirs.encode("a b", add_special_tokens=False).ids
