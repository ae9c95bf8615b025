"""Nearest neighbours against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetscope.llm.common import table
from packetscope.llm.neighbours import _walk, beam_for, nearest, tables_for


def brute(rows, asked, k):
    fine = {}
    for i, v in rows:
        if i is None or v is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        if any(v) and len(v) == 3:
            fine[i] = min(fine.get(i, v), v)
    ids = sorted(fine)
    out = []
    for q in ids:
        if asked(q):
            a = np.asarray(fine[q], np.float64)
            scored = []
            for i in ids:
                if i != q:
                    b = np.asarray(fine[i], np.float64)
                    x, y = a / np.abs(a).max(), b / np.abs(b).max()
                    scored.append((-float(x @ y) / (float(np.sqrt(x @ x)) * float(np.sqrt(y @ y))), i))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_small_table_is_answered_exactly(spark):
    rnd = random.Random(14)
    rows = [(i, [float(np.float32(rnd.gauss(0, 1))) for _ in range(3)]) for i in range(40)]
    rows += [(50 + i, [1.0, 2.0, 3.0]) for i in range(12)] + [(70, [2.0, 4.0, 6.0])]
    rows += [(80, None), (81, [0.0, 0.0, 0.0]), (82, [1.0, None, 0.0]), (83, [math.nan, 1.0, 1.0]),
             (84, [math.inf, 1.0, 1.0]), (85, []), (86, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]),
             (3, rows[3][1]), (4, [9.0, 9.0, -9.0]), (87, [1e30, 1e30, 0.0]), (88, [1e-30, 1e-30, 0.0])]
    table_ = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, node int, rank int")
    got = sorted(tuple(r) for r in nearest(table_, F.col("vec_id") % 5 == 0, 5).collect())
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], lambda q: q % 5 == 0, 5)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_few_rows_and_none(spark):
    kinds = "vec_id long, embedding array<float>"
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], kinds)
    assert [tuple(r)[:3] for r in nearest(two, F.col("vec_id") == 0, 5).collect()] == [(0, 1, 1)]
    assert nearest(two.limit(1), F.lit(True), 5).count() == 0
    assert nearest(two.limit(0), F.lit(True), 5).count() == 0


def test_recall(spark):
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    got = nearest(vectors, F.col("vec_id") % 50 == 0, 5).toPandas()
    rows = vectors.toPandas().sort_values("vec_id")
    x = np.stack(rows.embedding).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = rows.vec_id.to_numpy()
    hits = total = 0
    for q, part in got.groupby("query_id"):
        near = x @ x[np.searchsorted(ids, q)]
        near[np.searchsorted(ids, q)] = -2
        fifth = np.sort(near)[-5]
        hits += (part.score >= fifth - 1e-9).sum()
        total += 5
    assert total == 5 * (ids % 50 == 0).sum() and hits / total >= 0.9


def test_walk_goes_on_until_it_has_looked_at_all_of_its_best(spark):
    n = 12
    turn = [np.array([math.cos(a), math.sin(a)], np.float16).tobytes() for a in np.linspace(1.5, 0, n)]
    # each node knows only the next one, and the last is the nearest to the query
    graph = spark.createDataFrame(
        [(i, [(i + 1, turn[i + 1])]) for i in range(n - 1)], "node long, around array<struct<other: long, unit: binary>>"
    )
    units = spark.createDataFrame([(100, turn[-1])], "query long, query_unit binary")
    starts = spark.createDataFrame([(100, 0, 0.0)], "query long, node long, near float")
    got = _walk(starts, graph, units, 4).orderBy(F.desc("near")).collect()
    assert [r.node for r in got] == [11, 10, 9, 8]


def test_plane_sets_and_beam_grow_with_the_rows():
    sizes = [0, 2_000, 150_000, 10_000_000]
    assert [tables_for(s) for s in sizes] == [32, 32, 64, 112]
    assert [beam_for(s) for s in sizes] == [64, 176, 288, 384]
