"""Wu-Manber search against every window of every text."""

import hashlib
import random
import re

import pytest

from packetscope.llm.decontamination import contamination, digests, united

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    ws, hit, found = words(text), set(), set()
    for item, body in items:
        iw = words(body)
        n = min(10, len(iw))
        for s in range(len(iw) - n + 1 if iw else 0):
            for at in range(len(ws) - n + 1):
                if ws[at : at + n] == iw[s : s + n]:
                    hit |= set(range(at, at + n))
                    found.add(str(item))
    joined = ",".join(sorted(found))
    return len(ws), len(hit), len(found), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(6)
    vocabulary = ["ab", "Cd", "ÉT", "é", "12", "x-y", "z!", "Straße"]
    make = lambda k: " ".join(rnd.choices(vocabulary, k=k))
    items = [(i, make(rnd.choice([1, 4, 9, 10, 11, 25]) + 2)) for i in range(12)]
    items += [(20, None), (21, ""), (22, "..."), (None, "ab Cd ab Cd"), (23, items[0][1]), (0, items[0][1]), (24, "qqq")]
    rows = [(i, make(rnd.randrange(40))) for i in range(60)]
    rows += [(100 + n, f"{make(5)} {t or ''} {make(4)}") for n, (_, t) in enumerate(items)]
    rows += [(200, None), (201, ""), (202, "QQQ qqq,qqq"), (202, "QQQ qqq,qqq"), (None, "qqq"), (203, "ab " * 4000)]
    return (
        spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, items int"),
        spark.createDataFrame(items, "item_id long, text string"),
        rows, [(i, t) for i, t in items if i is not None and t is not None],
    )


@pytest.mark.parametrize("pass_bytes", [1 << 20, 300])
def test_hits(tables, pass_bytes):
    docs, benchmark, rows, items = tables
    got = digests(contamination(docs, benchmark, pass_bytes=pass_bytes)).collect()
    want = [(i, *brute(t, items)) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty_tables(spark, tables):
    docs, benchmark, rows, _ = tables
    assert contamination(docs.limit(0), benchmark).count() == 0
    got = digests(contamination(docs, benchmark.limit(0))).collect()
    assert len(got) == len(rows) and not any(r.contaminated for r in got)


def test_united():
    assert united([(3, 5), (0, 2), (2, 4), (9, 10)]) == [(0, 5), (9, 10)]
