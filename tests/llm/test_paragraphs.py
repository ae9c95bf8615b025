"""Repeated paragraphs against all pairs."""

import random

import pytest

from packetscope.llm.common import words_of
from packetscope.llm.paragraphs import LEAST_WORDS, paragraphs_of, repeated_paragraphs


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def make_rows():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdefé", k=rnd.randrange(3, 8)))
    sentence = lambda k: " ".join(word() for _ in range(k)).capitalize() + "."
    passages = [" ".join(sentence(rnd.randrange(5, 20)) for _ in range(7)) for _ in range(3)]
    line = sentence(12)
    rows = []
    for i in range(60):
        parts = [sentence(rnd.randrange(1, 30)) for _ in range(rnd.randrange(1, 8))]
        if i % 4 == 0:
            parts.insert(rnd.randrange(len(parts) + 1), word() + " " + passages[i % 3])
        if i % 5 == 0:
            near = passages[i % 3].split(" ")
            near[rnd.randrange(len(near))] = word()
            parts.append("\n" + " ".join(near))
        if i % 3 == 0:
            parts.append("\n" + line)
        rows.append((i, "  ".join(parts)))
    rows += [(100, None), (101, ""), (102, " \n . "), (103, line + "\n" + line), (103, line + "\n" + line), (None, line)]
    rows += [(104, "no stop " * 5000), (105, "no stop " * 5000 + "!")]
    return rows, passages


ROWS, PASSAGES = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    data = [(d, t, 1, "x") for d, t in ROWS]
    return spark.createDataFrame(data, "doc_id long, text string, place int, root string").repartition(4)


def test_cuts():
    text = " Ab cd. Ef gh!  Ij\n\nkl mn "
    for cut in (1, 2, 1000):
        spans = paragraphs_of(text, cut)
        assert "".join(text[a:b] for a, b in spans).replace(" ", "") == text.replace(" ", "").replace("\n", "")
    assert [text[a:b] for a, b in paragraphs_of(text, 1)] == ["Ab cd.", "Ef gh!", "Ij", "kl mn"]
    assert paragraphs_of("") == [] and paragraphs_of(" \n ") == []


def test_agrees_with_all_pairs(docs):
    items = []
    for d, text in ROWS:
        for place, (a, b) in enumerate(paragraphs_of(text or "")):
            if len(words_of(text[a:b])) >= LEAST_WORDS:
                items.append((d, place, a, b, shingles(text[a:b]), b" ".join(words_of(text[a:b]))))
    top = list(range(len(items)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, x in enumerate(items):
        for j, y in enumerate(items[:i]):
            if x[5] == y[5] or 5 * len(x[4] & y[4]) >= 4 * len(x[4] | y[4]):
                top[find(i)] = find(j)
    groups = {}
    for i, item in enumerate(items):
        groups.setdefault(find(i), []).append(item[:4])
    want = []
    for group in groups.values():
        if len(group) > 1:
            first = min(group, key=lambda g: (g[0] is None, g[0], g[1]))[:2]
            want += [(*g, *first, g[:2] != first) for g in group]
    got = [tuple(r) for r in repeated_paragraphs(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len(got) > 50


def test_passages_are_found_in_other_surroundings(docs):
    found = {}
    for r in repeated_paragraphs(docs).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.end))
    texts = dict(ROWS)
    for i in range(0, 60, 4):
        start = texts[i].find(PASSAGES[i % 3])
        inside = [b - a for a, b in found[i] if a >= start and b <= start + len(PASSAGES[i % 3])]
        assert sum(inside) > 0.2 * len(PASSAGES[i % 3])


def test_empty_table(spark):
    assert repeated_paragraphs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
