"""Words, paragraphs, shingles and links of whole batches against plain versions."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from packetscope.llm import comparing, linking
from packetscope.llm.common import words_of
from packetscope.llm.comparing import links_within
from packetscope.llm.cutting import Texts, run_hashes, shingled
from packetscope.llm.paragraphs import paragraphs_of

PARTS = ["a", "b.", "c!", "é", "日", " ", "  ", "\n", " \n", "\xa0", "　", "\x85", "x y. ", "Z? ", "w" * 9, "v" * 90]


def texts():
    rnd = random.Random(2)
    made = ["".join(rnd.choices(PARTS, k=rnd.randrange(30))) for _ in range(600)]
    return made + ["", " ", "One two. \nThree four.", "The last line ends so. \n"]


def plain(text, cut):
    """Piece by piece between white space."""
    pieces = list(re.finditer(r"\S+", text))
    out, line, start = [], [], None
    for n, m in enumerate(pieces):
        start = m.start() if start is None else start
        gap = text[m.end() : pieces[n + 1].start()] if n + 1 < len(pieces) else "\n"
        if "\n" in gap:
            chosen = {min(line[i : i + cut]) for i in range(len(line) - cut + 1)}
            for e in [*(e for e in line if e in chosen), (0, m.end(), n)]:
                out.append((start, e[1]))
                start = pieces[e[2] + 1].start() if e[2] + 1 < len(pieces) else None
            line = []
        elif m[0][-1] in ".!?":
            line.append((zlib.crc32(m[0].encode()), m.end(), n))
    return out


@pytest.mark.parametrize("cut", [1, 2, 3])
def test_paragraphs(cut):
    for text in texts():
        assert paragraphs_of(text, cut) == plain(text, cut)


def test_white_space_before_a_new_line_ends_the_line():
    text = "One two. \nThree four. \n"
    assert [text[a:b] for a, b in paragraphs_of(text)] == ["One two.", "Three four."]


def test_words():
    batch = Texts(pa.array(texts()))
    begin, end = batch.words()
    first = np.append(np.searchsorted(begin, batch.begins), len(begin))
    found = [batch.lower[a:b] for a, b in zip(begin, end)]
    assert [found[a:b] for a, b in zip(first, first[1:])] == [words_of(t) for t in texts()]
    hashes = batch.hashes(begin, end).tolist()
    assert len(set(zip(hashes, found))) == len(set(hashes)) == len(set(found))


def test_shingles():
    words = [[1, 2, 3], [], [4, 5, 6, 7, 8, 9], [1], [1, 2, 3], [4, 5, 6, 7, 8]]
    flat = np.asarray([w for group in words for w in group], np.uint64)
    values, counts = shingled(flat, np.asarray([len(w) for w in words]), 5)
    assert counts.tolist() == [1, 0, 2, 1, 1, 1]
    assert values[0] == values[4] and values[1] == values[5] and len(set(values.tolist())) == 4
    for n in range(1, 9):
        assert run_hashes(flat, n)[:1] == run_hashes(flat[:n], n) and len(run_hashes(flat, n)) == len(flat) - n + 1


def test_links_connect_what_is_similar():
    rnd = random.Random(3)
    for _ in range(100):
        bucket = np.asarray(sorted(rnd.choices(range(4), k=20)))
        base = [rnd.sample(range(40), 12) for _ in range(3)]
        sets = [np.asarray(sorted({*rnd.choice(base)[rnd.randrange(3) :], rnd.randrange(99)}), np.uint64) for _ in bucket]
        x, y = links_within(bucket, np.asarray([len(s) for s in sets]), np.concatenate(sets), 0.7)
        alike = lambda i, j: 10 * len(np.intersect1d(sets[i], sets[j])) >= 7 * len(np.union1d(sets[i], sets[j]))
        assert all(bucket[i] == bucket[j] and alike(i, j) for i, j in zip(x, y))
        root = list(range(20))
        for i, j in zip(x.tolist(), y.tolist()):
            root = [root[j] if r == root[i] else r for r in root]
        assert all(root[i] == root[j] for i in range(20) for j in range(i) if bucket[i] == bucket[j] and alike(i, j))


def test_large_buckets_go_through_the_rounds(spark, monkeypatch):
    sets = [list(range(a, a + 10)) for a in (0, 1, 2, 100, 101, 500)]
    rows = [(bytes([n]), [7, 8] if n < 5 else [9], np.asarray(s, np.uint64).tobytes()) for n, s in enumerate(sets)]
    rows += rows[:2]
    items = spark.createDataFrame(rows, "key binary, buckets array<long>, values binary")
    got = []
    for most in (1024, 2):
        monkeypatch.setattr(linking, "WITHIN", most)
        got.append(sorted((bytes(r.key)[0], bytes(r.root)[0]) for r in linking.classes_of_sets(items, 0.8).collect()))
    assert got == [[(0, 0), (1, 0), (2, 0), (3, 3), (4, 3)]] * 2


def crowd(rng, n):
    """Sets with values in common that are unlike all the same, and some copies with a value changed."""
    base, sets = rng.integers(1, 2**63, 10).astype(np.uint64), []
    for _ in range(n):
        if sets and rng.random() < 0.2:
            made = sets[rng.integers(len(sets))].copy()
            made[rng.integers(len(made))] = rng.integers(1, 2**63)
        else:
            made = np.append(base[rng.integers(0, 4) :], rng.integers(1, 2**63, rng.integers(2, 25)).astype(np.uint64))
        sets.append(np.unique(made))
    return sets


def roots(sets, least):
    top = np.arange(len(sets))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(np.intersect1d(a, b))
            if 1000 * common >= round(1000 * least) * (len(a) + len(b) - common):
                top[top == max(top[i], top[j])] = min(top[i], top[j])
    return top


def test_in_a_crowded_bucket_hardly_any_unlike_sets_meet(monkeypatch):
    asked, kept = [], comparing._enough
    monkeypatch.setattr(comparing, "_enough", lambda c, *a: (asked.append(len(c)), kept(c, *a))[1])
    rng = np.random.default_rng(4)
    for least in (0.5, 0.7, 0.8, 1.0):
        sets = crowd(rng, 150) + crowd(rng, 90) + crowd(rng, 20)
        bucket = np.repeat([-7, 5, 2**62], [150, 90, 20])
        x, y = links_within(bucket, np.asarray([len(s) for s in sets]), np.concatenate(sets), least)
        want = np.concatenate([roots(sets[a:b], least) + a for a, b in ((0, 150), (150, 240), (240, 260))])
        assert comparing.roots_of(x, y, 260).tolist() == want.tolist()
        assert least == 1.0 or len(x) > 20
    # of two thousand sets in a bucket there are two million pairs
    sets, asked[:] = crowd(rng, 2000), []
    links_within(np.zeros(2000, np.int64), np.asarray([len(s) for s in sets]), np.concatenate(sets), 0.8)
    assert sum(asked) < 20_000


def test_a_bucket_beyond_one_worker_takes_no_rounds_for_unlike_sets(spark, monkeypatch):
    rng = np.random.default_rng(12)
    sets = crowd(rng, 120)
    key = lambda i: int(i).to_bytes(2, "big")
    rows = [(key(i), [9], s.tobytes()) for i, s in enumerate(sets)]
    names, kept = [], linking.written
    monkeypatch.setattr(linking, "written", lambda df, name: (names.append(name), kept(df, name))[1])
    monkeypatch.setattr(linking, "WITHIN", 40)
    got = linking.classes_of_sets(spark.createDataFrame(rows, "key binary, buckets array<long>, values binary"), 0.8)
    found = {bytes(r.key): bytes(r.root) for r in got.collect()}
    want = roots(sets, 0.8)
    several = np.bincount(want)[want] > 1
    assert found == {key(i): key(want[i]) for i in np.flatnonzero(several)} and len(found) > 20
    assert names.count("apart") == 1 and names.count("hubs") <= 1
