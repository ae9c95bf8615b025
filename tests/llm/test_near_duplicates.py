"""ProbMinHash, linking and classes against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packetscope.llm import linking
from packetscope.llm.common import words_of
from packetscope.llm.comparing import alike, probability_jaccard, roots_of
from packetscope.llm.linking import classes, classes_of_sets, connected, repeated
from packetscope.llm.near_duplicates import (
    near_duplicates, prob_minhash, without_near_duplicates,
)
from packetscope.llm.shingles import Shingler, counted, mixed, tuned


def shingles(text):
    w = words_of(text or "")
    if not w:
        return {}
    c = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    return {k: 1 + math.log(n) for k, n in c.items()}


def similarity(a, b):
    every = set(a) | set(b)
    return sum(
        1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in every) for d in set(a) & set(b)
    )


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and similarity(sets[i], sets[j]) >= 0.8:
                top[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return [(d, least[find(i)]) for i, (d, _) in enumerate(rows)]


def make_rows():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randrange(2, 6)))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rnd.randrange(1, 120))]
        for _ in range(rnd.choice([1, 1, 2, 5, 9])):
            copy = list(base)
            for _ in range(rnd.randrange(0, 4)):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((len(rows) + 1, rnd.choice([" ", ", ", "\n"]).join(copy)))
    line = "the same line again and again "
    rows += [(500, line * 40), (501, line * 40 + "x"), (502, line * 9), (503, None), (504, ""), (505, "..."),
             (506, "one two"), (507, "One, two!"), (None, "one two"), (508, "one two"), (508, "one two"),
             (None, "alone here"), (509, "z " * 9000), (510, "z " * 9001)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(d, t, "k", 1) for d, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, key string, root int").repartition(5)


def test_classes_are_those_of_all_pairs(docs, rows):
    got = near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=repr) == sorted(brute(rows), key=repr)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got if None not in (r.doc_id, r.class_id))


def test_one_of_each_class_stays(docs, rows):
    left = without_near_duplicates(docs)
    assert left.columns == docs.columns
    got = Counter(r.doc_id for r in left.collect())
    words = {d for d, t in rows if words_of(t or "")}
    roots = Counter(c for d, c in set(brute(rows)) if d is not None and d == c and d in words)
    roots.update([None, 503, 504, 505])  # "alone here", and three without words
    assert got == roots


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).count() == 0
    assert without_near_duplicates(empty).count() == 0


def test_signatures_estimate_the_similarity():
    rnd = np.random.default_rng(9)
    values = rnd.integers(1, 2**63, 300).astype(np.uint64)
    values.sort()
    wa, wb = rnd.integers(1, 9, 300).astype(float), rnd.integers(1, 9, 300).astype(float)
    a, b = slice(0, 220), slice(60, 300)
    exact = probability_jaccard(values[a], wa[a], values[b], wb[b])
    plain = similarity(dict(zip(values[a].tolist(), wa[a])), dict(zip(values[b].tolist(), wb[b])))
    assert exact == pytest.approx(plain)
    signed = prob_minhash(
        np.concatenate([values[a], values[b]]), np.concatenate([wa[a], wb[b]]),
        np.repeat([0, 1], [220, 240]), 2, 4096,
    )
    assert abs((signed[0] == signed[1]).mean() - exact) < 0.03


def test_plain_weights_give_jaccard():
    a, b = np.arange(0, 90, dtype=np.uint64), np.arange(10, 100, dtype=np.uint64)
    assert probability_jaccard(a, np.ones(90), b, np.ones(90)) == pytest.approx(0.8)


def test_shingles():
    values, texts = Shingler()([[], [b"a"], [b"a", b"b"], [b"a"] * 7, [b"a"]])
    assert texts.tolist() == [1, 2, 3, 3, 3, 4]
    assert values[0] == values[5] and len(set(values.tolist())) == 3
    assert counted(values, texts)[2].tolist() == [1, 1, 3, 1]


def test_tuning():
    bands, rows = tuned(0.8, 0.9995)
    assert (1 - 0.8**rows) ** bands <= 0.0005


def test_repeated(spark):
    hashes = mixed(np.arange(1, 151, dtype=np.uint64)).astype(np.int64)
    rows = [(h, v) for i, h in enumerate(hashes[:100].tolist()) for v in range(1 + i % 2)] * 2
    found = repeated(spark.createDataFrame(rows, "h long, v long")).has(hashes)
    assert found.tolist() == [i % 2 == 1 and i < 100 for i in range(150)]


def test_components(spark):
    rnd = random.Random(10)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    top = {}
    for a, b in links:
        if a != b:
            top.setdefault(a, a), top.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a != b and top[a] != top[b]:
                top[a] = top[b] = min(top[a], top[b])
                changed = True
    assert got == top


def test_many_links_are_joined_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(linking, "ONE_WORKER_LINKS", -1)
    test_components(spark)
    monkeypatch.setattr(linking, "ONE_WORKER_LINKS", 40)
    test_components(spark)
    assert connected(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_forests_can_be_grown_after_classes(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    connected(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).collect()
    rows = spark.createDataFrame([(float(i), float(i % 2)) for i in range(40)], "x double, label double")
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=2, seed=1).fit(rows)
    assert len(model.transform(rows).select("probability", "prediction").collect()) == 40


def test_roots_are_the_least_of_what_links_connect():
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    x, y = np.append(x, np.arange(400, 499)), np.append(y, np.arange(401, 500))
    want = list(range(500))
    for _ in want:
        for a, b in zip(x.tolist(), y.tolist()):
            want[a] = want[b] = min(want[a], want[b])
    assert roots_of(x, y, 500).tolist() == want
    assert roots_of(x[:0], y[:0], 3).tolist() == [0, 1, 2]


def test_a_bitmap_does_not_take_a_job_for_each_partition(spark):
    settings = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    rows = spark.range(4000).selectExpr("xxhash64(id div 2) AS h", "id AS v")
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        spark.sparkContext.setJobGroup("bitmap", "")
        assert repeated(rows).has(np.asarray([r.h for r in rows.collect()])).all()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("bitmap")) < 20
    finally:
        spark.sparkContext.setJobGroup("", "")
        for name, value in before.items():
            spark.conf.set(name, value)


def test_a_worker_joins_the_chains_it_finds(spark, monkeypatch):
    names, kept = [], linking.written
    monkeypatch.setattr(linking, "written", lambda df, name: (names.append(name), kept(df, name))[1])
    key = lambda i: (99 - i).to_bytes(2, "big")
    values = np.arange(9, dtype=np.uint64).tobytes()
    items = [(key(i), [i, i + 1], values) for i in range(60)] + [(key(70), [70], values)]
    found = classes_of_sets(spark.createDataFrame(items, "key binary, buckets array<long>, values binary"), 0.8)
    assert {bytes(r.key): bytes(r.root) for r in found.collect()} == {key(i): key(59) for i in range(60)}
    # what the links are at first, and once more to see that nothing changes
    assert names.count("edges") == 2


def body(values, weights=None):
    packed = None if weights is None else np.asarray(weights, np.float64).tobytes()
    return {"values": np.sort(np.asarray(values, np.uint64)).tobytes(), "weights": packed}


@pytest.mark.parametrize(("room", "joined"), [(0, 2), (1000, 2), (1000, 0), (linking.BROADCAST_BYTES, 0)])
def test_a_crowded_bucket_is_checked_whole(spark, monkeypatch, room, joined):
    """Items of one bucket, linked only to their neighbours in a chain; with hubs that are
    joined, both in turn, and broadcast."""
    monkeypatch.setattr(linking, "BROADCAST_BYTES", room)
    monkeypatch.setattr(linking, "JOINED_ROUNDS", joined)
    n = 40
    start = [i + (9 if i >= 30 else 0) for i in range(n)]
    key = lambda i: i.to_bytes(2, "big")
    members = spark.createDataFrame([(1, key(i)) for i in range(n)], "bucket long, key binary")
    content = spark.createDataFrame(
        [(key(i), body(range(s, s + 10))) for i, s in enumerate(start)],
        "key binary, body struct<values: binary, weights: binary>",
    )
    found = classes(members, content, 0.8).collect()
    assert {bytes(r.key): bytes(r.root) for r in found} == {key(i): key(0 if i < 30 else 30) for i in range(n)}


def test_many_hubs_at_once_are_the_pairs_one_by_one():
    rng = np.random.default_rng(5)
    sets = []
    for i in range(60):
        values = np.unique(np.append(rng.choice(40, rng.integers(25, 40), replace=False), 100 * (i % 3)))
        weights = 1 + np.log(rng.integers(1, 4, len(values))) if i % 2 else None
        sets.append({"root": bytes([i]), "buckets": [i % 2, 2 + i % 5], **body(values, weights)})
    hubs = linking.Hubs(pa.Table.from_pylist(sets[:30]))
    linked = 0
    for x in sets:
        for least in (0.3, 0.5, 0.7):
            want = {
                y["root"] for y in sets[:30]
                if x["root"] != y["root"] and set(x["buckets"]) & set(y["buckets"]) and alike(x, y, least)
            }
            assert hubs(x["root"], x["buckets"], x["values"], x["weights"], least) == want
            linked += len(want)
    assert linked > 100


def test_rows_of_one_id_and_equal_words(spark):
    rows = [(1, "x", "a b c d e f"), (1, "y", "A b c d e f"), (1, "b", "A b c d e f"), (2, None, "a b, c d e f")]
    rows += [(None, "z", "n o p q r s"), (None, None, "n o p q r s"), (None, "z", "N o p q r s?"), (3, "w", "")]
    schema = "doc_id long, lang string, text string"
    want = {(1, "b", "A b c d e f"), (None, "z", "N o p q r s?"), (3, "w", "")}
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, schema).repartition(parts)
        assert {tuple(r) for r in without_near_duplicates(docs).collect()} == want
    mapped = spark.createDataFrame(rows, schema).withColumn("m", F.create_map(F.lit("k"), F.col("lang")))
    got = without_near_duplicates(mapped)
    assert got.columns == ["doc_id", "lang", "text", "m"]
    assert {(r.doc_id, r.lang, r.text, r.m["k"]) for r in got.collect()} == {(*w, w[1]) for w in want}
