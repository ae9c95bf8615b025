"""Batches encoded as arrays against the library, and how little is merged twice."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from packetscope.llm import batching
from packetscope.llm.batching import BatchEncoder
from tests.llm.test_encoding import TEXTS

PATH = public_tokenizers.path("byte_bpe_50k.json")


def encoder():
    with open(PATH, encoding="utf-8") as f:
        return BatchEncoder(f.read())


def texts():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdeé日ß.,!'-#7Ж\0  ", (9,) * 6 + (1,) * 13, k=rnd.randrange(1, 22)))
    made = ["".join(word() + rnd.choice((" ", " ", "\n")) for _ in range(rnd.randrange(0, 60))).strip() for _ in range(400)]
    return [t or "" for t in TEXTS] + made + ["a", "a\nb", "same same\nsame", "x" * 15, "x" * 16, "é" * 8 + " " + "é" * 7]


@pytest.mark.parametrize("kept", [0, 50, 1 << 19])
def test_agrees_with_the_library(monkeypatch, kept):
    monkeypatch.setattr(batching, "KEPT", kept)
    library, made, all_texts = Tokenizer.from_file(PATH), encoder(), texts()
    for size in (1, 37, 1000):
        for at in range(0, len(all_texts), size):
            part = all_texts[at : at + size]
            for text, ids in zip(part, made.encode(part), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_pieces_of_earlier_batches_are_not_merged_again(monkeypatch):
    made, merged = encoder(), []
    kept = made._merge
    monkeypatch.setattr(made, "_merge", lambda words: merged.extend(words) or kept(words))
    part = ["some words, of\na text " * 3 + "end."]
    first = made.encode(part)
    made.pieces.clear()
    made.words.clear()
    before = len(merged)
    assert made.encode(part) == first and before and len(merged) == before


def test_two_pieces_of_one_hash(monkeypatch):
    monkeypatch.setattr(batching, "mixed", lambda x: x * np.uint64(0))
    library = Tokenizer.from_file(PATH)
    part = ["one two\nthree", "four"]
    for text, ids in zip(part, encoder().encode(part)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_with_and_without_marks_are_one_piece(monkeypatch):
    library, made, merged = Tokenizer.from_file(PATH), encoder(), []
    made.encode(["some unusualword\nunusualword here some"])
    made.pieces.clear()
    made.words.clear()
    kept = made._merge
    monkeypatch.setattr(made, "_merge", lambda words: merged.extend(words) or kept(words))
    text = "some unusualword, here! some: unusualword.\nunusualword? here;"
    (ids,) = made.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert not merged
