"""Packing: every id in one place, full sequences, order along the curve."""

import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from packetscope.llm.hilbert import hilbert_keys
from packetscope.llm.merging import Encoder
from packetscope.llm.packing import digests, pack
from tests.llm.test_encoding import TEXTS

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 5 else None, t, "row") for i, t in enumerate(TEXTS)]
    rows += [(100 + i, "copies of one text with some words " * 9, "key") for i in range(60)]
    rows += [(100, "copies of one text with some words " * 9, "key")] * 2
    rows += [(200, "very long " * 20_000, "n")]
    return spark.createDataFrame(rows, "doc_id long, text string, position string")


@pytest.mark.parametrize("length", [7, 1024])
def test_every_id_lies_in_one_piece(docs, length):
    library = Tokenizer.from_file(PATH)
    rows = pack(docs, length).collect()
    documents, open_parts = [], {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        # pieces of a document follow one another, so only the last document is unfinished
        if r["start"] == 0:
            assert not open_parts
            open_parts = {"id": r["doc_id"], "n": r["doc_tokens"], "ids": []}
        assert (open_parts["id"], open_parts["n"], len(open_parts["ids"])) == (
            r["doc_id"], r["doc_tokens"], r["start"])
        open_parts["ids"] += ids
        if len(open_parts["ids"]) == r["doc_tokens"]:
            documents.append((open_parts["id"], open_parts["ids"]))
            open_parts = {}
    want = [
        (i, library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, _ in docs.collect()
    ]
    assert sorted(documents, key=repr) == sorted(want, key=repr)
    filled = {}
    for r in rows:
        assert r["offset"] + r["length"] <= length
        filled[r["sequence_id"]] = filled.get(r["sequence_id"], 0) + r["length"]
    total = sum(len(ids) for _, ids in want)
    assert sorted(filled) == list(range(-(-total // length)))
    assert all(n == length for s, n in filled.items() if s < max(filled))


def test_digests(docs):
    for r in digests(pack(docs.where("doc_id = 3"))).collect():
        ids = Tokenizer.from_file(PATH).encode(TEXTS[3], add_special_tokens=False).ids + [0]
        assert r.asDict() == {
            "doc_id": 3, "start": 0, "length": len(ids), "doc_tokens": len(ids), "sequence_id": 0,
            "offset": 0, "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes()),
        }


def test_copies_are_neighbours(docs):
    rows = pack(docs).where("doc_id BETWEEN 101 AND 159").collect()
    at = [1024 * r["sequence_id"] + r["offset"] for r in rows if r["start"] == 0]
    size = rows[0]["doc_tokens"]
    assert max(at) - min(at) < (len(at) + 3) * size


def test_empty_table(docs):
    assert pack(docs.limit(0)).count() == 0


def test_encoder_keeps_to_the_library_when_caches_are_cleared(monkeypatch):
    monkeypatch.setattr("packetscope.llm.merging.REMEMBERED", 2)
    library = Tokenizer.from_file(PATH)
    with open(PATH, encoding="utf-8") as f:
        encoder = Encoder(f.read())
    texts = [t or "" for t in TEXTS]
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_keys_walk_the_grid():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    keys = hilbert_keys(grid, 3)
    walk = grid[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
