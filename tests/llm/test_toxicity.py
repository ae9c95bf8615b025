"""The classifier on held-out rows, and its edges."""

import random
import zlib

import numpy as np
import pytest

from packetscope.llm.toxicity import best_cut, rows_of, score_documents, train

KINDS = "doc_id long, text string, lang string, score int"


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(15)
    word = lambda: "".join(rnd.choices("aeioulmnrst", k=rnd.randrange(2, 8)))
    common = [word() for _ in range(300)]
    docs, labels = [], []
    for i in range(700):
        words = rnd.choices(common, k=rnd.randrange(20, 120))
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), "grobbl" + word())
        docs.append((i, " ".join(words), "en" if i % 2 else "de", 0))
        labels.append((i, int(bad)))
    docs += [(9000, None, "en", 0), (9001, "", None, 0), (None, "plain", "xx", 0), (9002, "z " * 9000, "en", 0), (9000, None, "en", 0)]
    labels += [(None, 1), (1, 1), (9999, 0)]  # 1 contradicts itself
    return spark.createDataFrame(docs, KINDS), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_rows_are_told_apart(tables):
    docs, labels = tables
    net = train(docs, labels, sample_per_class=300)
    rows = score_documents(docs, net).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(key.encode()) % 5 == 0)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 700]
    right = sum(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert len(held) > 100 and right / len(held) > 0.95


def test_without_labels_and_without_rows(spark, tables):
    docs, labels = tables
    net = train(docs, labels.limit(0))
    assert len({r.score for r in score_documents(docs, net).collect()}) == 1
    assert score_documents(docs.limit(0), net).count() == 0


def test_cut_and_rows():
    scores, labels = np.asarray([3.0, 2.0, 1.0, 0.0]), np.asarray([1, 1, 0, 0])
    assert best_cut(scores, labels) == 1.5
    rows, starts = rows_of([b"a", b"abcdef", b""])
    # a word of its own row, and "<abcd", "abcde", "bcdef", "cdef>"
    assert np.diff(np.append(starts, len(rows))).tolist() == [1, 5, 1]


def test_rows_beyond_the_start_are_learned_from(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("aeioulmnrst", k=rnd.randrange(2, 8)))
    common, marks = [word() for _ in range(300)], ["".join(rnd.choices("bcdfghjkpqvwxyz", k=9)) for _ in range(24)]
    docs, labels = [], []
    for i in range(2400):
        words = rnd.choices(common, k=rnd.randrange(10, 30))
        if i % 3 == 0:
            words[rnd.randrange(10)] = marks[i // 3 % 24]
        docs.append((i, " ".join(words), "en", 0))
        labels.append((i, int(i % 3 == 0)))
    docs, labels = spark.createDataFrame(docs, KINDS), spark.createDataFrame(labels, "doc_id long, toxic int")
    # the start sees at most 12 of the 24 marks
    net = train(docs, labels, sample_per_class=12)
    held = [r for r in score_documents(docs, net).collect() if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in held) / len(held) > 0.95
    again = train(docs.repartition(7), labels.repartition(3), sample_per_class=12)
    assert (net.flat() == again.flat()).all() and net.thresholds == again.thresholds
