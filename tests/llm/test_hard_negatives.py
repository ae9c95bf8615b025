"""Hard negatives against all scores of a small table."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetscope.llm import hard_negatives as H

KIND = "vec_id long, label int, embedding array<float>, key string"


def plain(rows, positives=5, negatives=3):
    usual = 8
    good = [
        (i, l, [math.floor(256 * x) for x in v]) for i, l, v, _ in rows
        if i is not None and l is not None and v is not None and len(v) == usual
        and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, l, v in good:
        if i % 50:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in good if j != i]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, j, _ in [s for s in scored if s[2] == l][:positives]:
            fit = [s for s in scored if s[2] != l and 50 * p <= 100 * s[0] <= 95 * p]
            out += [(i, j, rank, s[1], p, s[0]) for rank, s in enumerate(fit[:negatives], 1)]
    return sorted(out)


def rows_of(seed, n=400, spread=1.0):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = centres[rnd.randrange(6)]
        v = [float(np.float32(x + rnd.gauss(0, spread))) for x in c]
        rows.append((i, rnd.randrange(4), v, "extra"))
    return rows


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, KIND).repartition(3)
    return sorted(map(tuple, H.hard_negatives(df, F.col("vec_id") % 50 == 0, **more).collect()))


def test_matches_all_scores(spark):
    rows = rows_of(1)
    want = plain(rows)
    assert want and found(spark, rows) == want
    # many small blocks, several chunks of anchors
    assert found(spark, rows, block=16, chunk_bytes=200) == want


def test_odd_rows_ties_and_copies(spark):
    rows = rows_of(2, 200)
    one = rows[50][2]
    rows += [(1000 + i, i % 3, one, None) for i in range(120)]  # one vector, three labels
    rows += [(1000, 1, one, None), (1003, 1, rows[3][2], None)]  # repeated rows and ids
    nan, inf = float("nan"), float("inf")
    rows += [
        (None, 1, one, None), (2000, None, one, None), (2050, 1, None, None), (2100, 1, [], None),
        (2150, 1, [None] + one[1:], None), (2200, 1, [nan] + one[1:], None),
        (2250, 1, one[:-1] + [-inf], None), (2300, 1, one[:3], None), (2350, 2, [0.0] * 8, None),
        (2400, 3, one, None), (2450, 2, [-x for x in one], None), (2500, 2, [float(np.float32(1e6 * x)) for x in one], None),
    ]
    want = plain(rows)
    got = found(spark, rows, block=32)
    assert got == want
    assert {2350, 2400, 2500} & {r[0] for r in want}


def test_few_rows(spark):
    assert found(spark, [(0, 1, [1.0] * 8, "")]) == []
    assert found(spark, []) == []
    two = [(0, 1, [1.0] * 8, ""), (1, 1, [1.0] * 8, ""), (2, 2, [0.9] * 8, "")]
    assert found(spark, two) == plain(two) != []


def test_zones_keep_blocks_closed(spark):
    """Clustered vectors: an anchor opens few blocks, and never misses a row for it."""
    rnd = random.Random(5)
    rows = []
    for i in range(600):
        centre = [0.0] * 8
        centre[i % 8] = 10.0
        rows.append((i, i // 8 % 3, [float(np.float32(x + rnd.gauss(0, 0.05))) for x in centre], ""))
    opened = []
    df = spark.createDataFrame(rows, KIND)
    keyed = H.with_keys(H.usable(df)).cache()
    blocks = [b.asDict() for b in H.blocks_of(keyed, 16).collect()]
    some = [r for r in rows if r[0] % 50 == 0]
    chunk = H._Chunk(
        np.arange(len(some)), np.array([r[0] for r in some]), np.array([r[1] for r in some]),
        H._whole([r[2] for r in some]),
    )
    chunk.least[:] = 256 * 256 * 50
    for zone in blocks:
        opened.append(H._needed(chunk, zone, slice(0, len(some)), None))
    share = np.mean(opened)
    assert 0 < share < 0.3
    for need, zone in zip(opened, blocks):
        values = H._unpacked(zone["form"], zone["values"], zone["rows"])
        labels = np.frombuffer(zone["of"], np.int64)
        scores = np.where(chunk.labels[:, None] == labels, chunk.values @ values.T, -np.inf)
        assert (need | (scores.max(1) < chunk.least)).all()
    keyed.unpersist()


def test_scores_that_do_not_fit_raise(spark):
    rows = [(0, 1, [1e30] * 8, ""), (1, 1, [1e30] * 8, ""), (2, 2, [1.0] * 8, "")]
    with pytest.raises(Exception, match="does not fit"):
        found(spark, rows)
