import random

import numpy as np
import public_tokenizers

from tallyweave.llm import token_store

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", " \n", "\t", " ", "​", "\x1c", "\x85", "'s", "<|endoftext|>", "é", "é.", "日本", "😀", ".", ",", "!!", "?", "a", "a,", "word", "word.", "Word!!", "3.", "23", "don't", "́", "﻿", "'", " '"]


def test_ids_are_the_librarys_for_odd_texts():
    own, rnd = token_store.Encoder(PATH), random.Random(3)
    for _ in range(4000):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14)))
        assert own.encode(text) == np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, own.width).tobytes(), repr(text)


def test_known_words_are_not_encoded_again_for_the_signs_after_them(monkeypatch):
    own = token_store.Encoder(PATH)
    own.encode("x lantern harbour meadow")
    asked, library = [], token_store.Encoder._library
    monkeypatch.setattr(token_store.Encoder, "_library", lambda self, pieces, marked: asked.extend(pieces) or library(self, pieces, marked))
    text = "x lantern, harbour. meadow!! lantern"
    assert own.encode(text) == np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, own.width).tobytes()
    assert not [p for p in asked if "lantern" in p or "harbour" in p or "meadow" in p]


def test_no_pieces_are_remembered_beyond_the_bound(monkeypatch):
    monkeypatch.setattr(token_store, "MEMO_WORDS", 3)
    own = token_store.Encoder(PATH)
    for text in ("x a b c, d", "x e f. g", "x a e f", "x " + "long" * 20):
        assert own.encode(text) == np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, own.width).tobytes()
    assert len(own.memo) == 5 and "e" not in own.memo


def test_texts_encoded_together_have_the_librarys_ids(monkeypatch):
    monkeypatch.setattr(token_store, "GROUP_CHARS", 60)
    own, rnd = token_store.Encoder(PATH), random.Random(5)
    parts = [*PARTS, *" \n" * 8, "\n\n", "\r\n", "###", "a_b", "--", "<|", "|>", "\"x\"", "größe", "ñandú!", "Ĳ", "ſt", "١٢", "ŉ", "a×b", "\x01", "\0"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20))) for _ in range(4000)]
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        assert ids == np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, own.width).tobytes(), repr(text)


def test_words_beside_line_breaks_and_signs_are_not_encoded_again(monkeypatch):
    own = token_store.Encoder(PATH)
    own.encode("a\nlantern b harbour é meadow")
    asked = []
    for name in ("_library", "_plain"):
        before = getattr(token_store.Encoder, name, None)
        monkeypatch.setattr(token_store.Encoder, name, lambda self, pieces, *more, f=before: asked.extend(pieces) or f(self, pieces, *more), raising=False)
    text = "a harbour.\nlantern meadow### b"
    assert own.encode(text) == np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, own.width).tobytes()
    assert not [p for p in asked if "lantern" in p or "harbour" in p or "meadow" in p]
