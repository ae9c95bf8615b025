"""Cross-entropy differences against models in plain dictionaries."""

import math
import random
from collections import Counter

import pytest

from packetscope.llm.common import words_of
from packetscope.llm.language_scores import cross_entropy_difference, numbered, questions


def brute(rows, wanted, share):
    plain = [words_of(t or "") for _, t in rows]
    n_words = len({w for t in plain for w in t}) + 1
    models = []
    for take in ([t for t, (d, _) in zip(plain, rows) if d in wanted], plain):
        single = Counter(w for t in take for w in t)
        pairs = Counter(p for t in take for p in zip(["<s>", *t], t))
        context = single.copy()
        context["<s>"] = sum(bool(t) for t in take)
        models.append((single, pairs, context, sum(single.values())))
    out = []
    for (d, _), t in zip(rows, plain):
        losses = []
        for single, pairs, context, total in models:
            loss = 0
            for a, b in zip(["<s>", *t], t):
                s = share if context[a] else 0
                loss -= math.log(s * pairs[a, b] / max(context[a], 1) + (1 - s) * (single[b] + 1) / (total + n_words))
            losses.append(loss / max(len(t), 1))
        out.append((d, len(t), *losses, losses[0] - losses[1]))
    return out


ROWS = []
rnd = random.Random(13)
for i in range(60):
    words = ["alpha", "beta", "gamma", "delta"] if i % 3 else ["one", "two", "three", "alpha"]
    ROWS.append((i, " ".join(rnd.choices(words, k=rnd.randrange(1, 50)))))
ROWS += [(100, None), (101, ""), (102, "?!"), (103, "unseen rare words"), (104, "Alpha " * 9000), (5, "one two"), (None, "one")]


# one block and range, and many of each
@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 300, "range_words": 400}])
def test_losses(spark, sizes):
    docs = spark.createDataFrame([(d, t, 0.5) for d, t in ROWS], "doc_id long, text string, score double").repartition(3)
    wanted = spark.createDataFrame([(i, 1) for i in range(0, 60, 3)] + [(0, 1), (None, 1), (999, 1)], "doc_id long, quality int")
    got = cross_entropy_difference(docs, wanted, share=0.6, **sizes).collect()
    want = brute(ROWS, set(range(0, 60, 3)), 0.6)
    key = lambda r: (str(r[0]), r[1], round(r[2], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:])
    score = {r.doc_id: r.score for r in got if r.n_words > 20 and r.doc_id is not None}
    assert max(s for d, s in score.items() if d < 60 and d % 3 == 0) < min(s for d, s in score.items() if d < 60 and d % 3)


def test_nothing_wanted_and_nothing_at_all(spark):
    docs = spark.createDataFrame(ROWS[:5], "doc_id long, text string")
    assert cross_entropy_difference(docs, docs.limit(0)).count() == 5
    assert cross_entropy_difference(docs.limit(0), docs).count() == 0


def test_every_bigram_counts(spark):
    """More distinct bigrams than any fixed table of 2^20 cells would tell apart."""
    rnd = random.Random(5)
    letters = [f"w{i}" for i in range(40000)]
    rows = [(i, " ".join(rnd.choices(letters, k=4000))) for i in range(300)]
    # a document that occurs twice is better known to the background than its like
    rows += [(1000, rows[7][1])]
    assert len({p for _, t in rows for p in zip(t.split(), t.split()[1:])}) > 1 << 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    good = spark.createDataFrame([(i,) for i in range(0, 300, 10)], "doc_id long")
    got = {r[0]: tuple(r) for r in cross_entropy_difference(docs, good, range_words=200_000).collect()}
    for row in brute(rows, set(range(0, 300, 10)), 0.7):
        assert got[row[0]] == pytest.approx(row)
    assert got[7][3] < min(r[3] for d, r in got.items() if d not in (7, 1000))


def test_texts_are_not_shuffled_to_be_marked(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    blocks = numbered(docs.where("text IS NOT NULL"), 300)
    plan = questions(blocks, docs.select("doc_id").distinct(), 3)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


def test_columns_of_other_names_and_text_ids(spark):
    docs = spark.createDataFrame([("a", "one two", 1), ("b", "two", 2), ("a", "one two", 1)], "key string, body string, block int")
    good = spark.createDataFrame([("a", "x")], "key string, ids string")
    got = cross_entropy_difference(docs, good, "key", "body").collect()
    want = brute([("a", "one two"), ("b", "two"), ("a", "one two")], {"a"}, 0.7)
    for a, b in zip(sorted(map(tuple, got)), sorted(want), strict=True):
        assert a == pytest.approx(b)
