"""The pipeline against plain versions of its stages, on the smallest tables."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from packetscope.llm import toxicity
from packetscope.llm.common import table, words_of
from packetscope.llm.secrets import Scanner, _without
from tests.llm.test_near_duplicates import shingles, similarity


def classes(docs):
    sets = {i: shingles(t) for i, t in docs.items()}
    top = {i: i for i in docs}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i].keys() & sets[j].keys() and similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages(spark, sf_dir, stages):
    docs, mild, single, clean, masked, encoded = stages
    assert all(s.columns == docs.columns for s in (mild, single, clean, masked))
    net = toxicity.train(docs, table(spark, sf_dir, "labels"))
    rejected = {r.doc_id for r in toxicity.score_documents(docs, net).where("rejected").collect()}
    first = texts(mild)
    assert set(first) == set(texts(docs)) - rejected
    root = classes(first)
    second = texts(single)
    assert set(second) == {i for i in first if root[i] == i or not words_of(first[i] or "")}
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    item_words = {w for _, t in items for w in words_of(t)}
    third = texts(clean)
    suspects = {i for i in second if len(item_words.intersection(words_of(second[i])))}
    assert set(third) == set(second) - {i for i in suspects if windows_hit(second[i], items)}
    scan = Scanner()
    fourth = texts(masked)
    assert fourth == {i: _without(t, scan([t])[0]) for i, t in third.items()}
    sizes = {r.doc_id: r.n_chars for r in masked.collect()}
    assert sizes == {i: len(t) for i, t in fourth.items()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = encoded.collect()
    assert {r.doc_id for r in rows} == set(fourth)
    for r in rows:
        ids = library.encode(fourth[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(fourth[r.doc_id].encode()).hexdigest()


def windows_hit(text, items):
    """Any ten consecutive words (or all of a shorter item) in the text."""
    words = words_of(text)
    for _, item in items:
        inside = words_of(item)
        n = min(10, len(inside))
        if n:
            wanted = {tuple(inside[i : i + n]) for i in range(len(inside) - n + 1)}
            if any(tuple(words[i : i + n]) in wanted for i in range(len(words) - n + 1)):
                return True
    return False


def test_empty_documents(spark, sf_dir):
    empty = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
