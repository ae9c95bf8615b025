"""BPE encoding, decoding and token counts against the library."""

import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from packetscope.llm.bpe import Vocabulary
from packetscope.llm.encoding import LexiconEncoder, digests, encode_documents
from packetscope.llm.lexicon import Lexicon, compile_lexicon, mapped
from packetscope.llm.merging import lone_spaces
from packetscope.llm.token_counts import count_tokens, with_limit

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))

TEXTS = [
    None,
    "",
    " ",
    "\n\n",
    "a",
    "Hello world, it's 2024!\n\nTwo  spaces \t tab\n",
    "  leading and trailing  ",
    "plain words with single spaces\nand lines\nhere",
    "a<|endoftext|>b <|endoftext|> <|startoftext|>c<|startoftext|>",
    "ÉTÉ straße ΣΊΣΥΦΟΣ İstanbul ñandú",
    "é combining Å  nbsp wide",
    "\x1c\x1d odd\x1espace\x85next",
    "newer letters ՘ ꟝ x",
    "日本語テキスト emoji 👩‍👩‍👧 ok",
    "x" * 5000,
    "thequickbrown" * 300,
    "word " * 3000,
    "don't we'll they're I'm you've she'd it's",
    "don't we'll they're I'm you've she'd it's",
    "tab\tone\rcr\x0bvt",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 7 else None, t, "other") for i, t in enumerate(TEXTS)]
    letters = "ab é'ñ\n 12.,ÀΣ"
    rnd = random.Random(1)
    rows += [(100 + i, "".join(rnd.choices(letters, k=rnd.randrange(60))), "x") for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_encodes_and_decodes_like_the_library(docs):
    library = Tokenizer.from_file(BYTE)
    got = encode_documents(docs, lexicon_size=200).collect()
    assert len(got) == docs.count()
    want = []
    for doc_id, text, _ in docs.collect():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    found = [(r[0], r[1], np.frombuffer(r[2], "<u4").tolist(), r[3]) for r in got]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_digests(spark, docs):
    row = digests(encode_documents(docs.where("doc_id = 1"), lexicon_size=10)).first()
    empty = hashlib.sha256(b"").hexdigest()
    assert row.asDict() == {
        "doc_id": 1, "n_tokens": 0, "ids_sha256": empty, "decoded_sha256": empty
    }


def test_counts_like_the_library(docs):
    library = Tokenizer.from_file(WORD)
    got = count_tokens(docs, table_size=50).collect()
    want = [
        (i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))
        for i, t, _ in docs.collect()
    ]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_limit(spark):
    rows = [(1, 1, 2048), (2, 1, 2049)]
    df = with_limit(spark.createDataFrame(rows, "doc_id long, n_bytes long, n_tokens long"))
    assert [r.over_limit for r in df.orderBy("doc_id").collect()] == [False, True]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert encode_documents(empty).count() == 0
    assert count_tokens(empty).count() == 0


def test_lexicon_holds_exactly_its_words_and_shares_states():
    rnd = random.Random(2)
    words = {bytes(rnd.choices(b"abc", k=rnd.randrange(1, 9))): [rnd.randrange(9)] * rnd.randrange(1, 4)
             for _ in range(500)}
    data = compile_lexicon(words)
    lexicon = Lexicon(mapped(data))
    probe = [bytes(rnd.choices(b"abcd", k=rnd.randrange(0, 11))) for _ in range(2000)] + list(words)
    for word, ids in zip(probe, lexicon.lookup(probe)):
        assert (None if ids is None else ids.tolist()) == words.get(word)
    assert lexicon.number(sorted(words)).tolist() == list(range(len(words)))
    endings = {a + b"ing": [1] for a in (b"walk", b"talk", b"sing")}
    assert len(Lexicon(compile_lexicon(endings)).keys) < sum(map(len, endings))


def test_empty_lexicon():
    assert Lexicon(compile_lexicon({})).lookup([b"a", b""]) == [None, None]


def test_long_and_short_merging_agree():
    with open(BYTE, encoding="utf-8") as f:
        vocabulary = Vocabulary.of(f.read())
    rnd = random.Random(3)
    for _ in range(300):
        ids = [vocabulary.first[b] for b in rnd.choices(b"thenarior sd", k=rnd.randrange(1, 40))]
        assert vocabulary._merge_short(list(ids)) == vocabulary._merge_long(list(ids))


def test_remembered_pieces_are_bounded_and_forgotten(monkeypatch):
    monkeypatch.setattr("packetscope.llm.encoding.REMEMBERED", 40)
    library = Tokenizer.from_file(BYTE)
    with open(BYTE, encoding="utf-8") as f:
        encoder = LexiconEncoder(f.read(), Lexicon(mapped(compile_lexicon({}))))
    for at in range(30):
        text = " ".join(f"w{chr(97 + at % 26)}x{i}, {chr(97 + i)}q" for i in range(20)) + "\nnext.\tline"
        (ids,) = encoder.encode([text])
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(encoder.pieces.now) <= 40 and len(encoder.pieces.old) <= 120
    encoder.forget()
    assert not any((encoder.pieces.now, encoder.pieces.old, encoder.words.now, encoder.words.old))


def test_lone_spaces():
    assert all(map(lone_spaces, ("a", "a b\nc", "É é")))
    assert not any(map(lone_spaces, (" a", "a\n", "a  b", "a\n\nb", "a \nb", "a\n b", "a\tb", "a\x1cb", "é\xa0b", "a é")))
