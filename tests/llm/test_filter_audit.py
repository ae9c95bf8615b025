"""Filter interactions against a plain count of every order."""

from itertools import permutations

import numpy as np
import pytest

from packetscope.llm.filter_audit import filter_interactions, positional_popcount

LONG = " ".join(f"w{i}" for i in range(250))
TEXTS = [
    None, "", "short", LONG, LONG, LONG.upper(), "a " * 300, "A1 " * 300, LONG + " $5",
    "x\x0by\x0cz\x1cq " * 100, "é" * 3 + " É" * 200, LONG + " # Z", "wört " * 60000, LONG,
]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, t, ["en", "de", None, ""][i % 4], "x", -1, True) for i, t in enumerate(TEXTS)]
    rows += [(3, LONG, "en", "x", 0, None), (None, LONG, "en", "x", 0, None), (None, "odd", "fr", "", 0, None)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, digest string, failed int, good boolean"
    )
    labels = spark.createDataFrame(
        [(3, 1, 0), (4, 0, 1), (4, None, None), (5, 1, 1), (5, 1, 1), (None, 1, 1), (99, 1, 1), (6, None, 1)],
        "doc_id long, quality int, toxic int",
    )
    return docs, labels


def plain(docs, labels):
    out, failed = {}, []
    least = {}
    for d in docs:
        if d["doc_id"] is not None:
            t = d["text"] or ""
            least[t] = min(least.get(t, d["doc_id"]), d["doc_id"])
    for d in docs:
        t = d["text"] or ""
        for c in "\x09\x0a\x0b\x0c\x0d":
            t = t.replace(c, " ")
        words = [w for w in t.split(" ") if w]
        t = d["text"] or ""
        own = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": d["doc_id"] is not None and d["doc_id"] > least[t],
        }
        mine = [x for x in labels if d["doc_id"] is not None and x["doc_id"] == d["doc_id"]]
        failed.append((
            d["lang"] or "", {k for k, v in own.items() if v},
            any(x["quality"] == 1 for x in mine), any(x["toxic"] == 1 for x in mine),
        ))
    for part in {f[0] for f in failed}:
        of = [f for f in failed if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                here = [f for f in of if x in f[1] and not f[1] & set(order[: step - 1])]
                out[part, order, step] = [
                    sum(not f[1] & set(order[:step]) for f in of), len(here),
                    sum(x in f[1] for f in of) - len(here), sum(f[1] == {x} for f in of),
                    sum(f[2] for f in here), sum(f[3] for f in here),
                ]
    for (part, order, step), row in out.items():
        row.append(sum(
            out[part, o, o.index(order[step - 1]) + 1][1] for o in map("".join, permutations("ABCDE"))
        ))
    return out


def test_every_order_and_step(tables):
    docs, labels = tables
    got = filter_interactions(docs, labels).collect()
    want = plain([r.asDict() for r in docs.collect()], [r.asDict() for r in labels.collect()])
    # plain() reads each row's other orders before its own shapley is appended to them
    assert {tuple(r[:3]): list(r[3:]) for r in got} == want
    assert len(got) == 600 * len({k[0] for k in want})


def test_empty_tables(tables):
    docs, labels = tables
    assert filter_interactions(docs.limit(0), labels).count() == 0
    rows = filter_interactions(docs, labels.limit(0)).collect()
    assert rows and all(r["good_lost"] == r["toxic_lost"] == 0 for r in rows)


def test_popcount_of_any_length():
    rng = np.random.default_rng(3)
    for n in (0, 1, 31, 64, 65, 93, 1000, 70_000):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        want = [int(((words >> b) & 1).sum()) for b in range(32)]
        assert positional_popcount(words).tolist() == want
