"""WARC records: framing, segments, revisits."""

import base64
import hashlib
import random
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from packetscope.llm.warc import (
    chunked, parsed, payload_of, read_pages, read_records, reassembled, record, unchunked, write_archives,
)


def test_chunked_framing():
    for size in (0, 1, 4095, 4096, 4097, 20000):
        payload = bytes(random.Random(size).randbytes(size))
        assert unchunked(chunked(payload)) == payload
    assert unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    assert unchunked(b"3\r\nab") is None and unchunked(b"zz\r\n") is None and unchunked(b"") is None
    assert payload_of(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"
    assert payload_of(b"no end") is None


def test_parser_goes_by_length():
    blocks = [b"", b"\r\n", b"\r\n\r\n", b"a\r\n\r\nWARC/1.1\r\n\r\nb\r\n", b"x\r\n\r\n\r\n", b"end"]
    data = b"".join(record({"WARC-Type": "x"}, b) + b"\r\n\r\n" for b in blocks)
    pieces = data.split(b"\r\n\r\n")[:-1]
    assert [b for _, b in parsed(iter(pieces))] == blocks
    with pytest.raises(ValueError):
        list(parsed(iter([b"junk"])))


def brute(rows, least=0):
    best = {}
    for page, html in rows:
        body = (html or "").encode()
        if len(body) >= least and page is not None:
            best[body] = max(best.get(body, page), page)
    counts = Counter((html or "").encode() for _, html in rows)
    out = []
    for page, html in rows:
        body = (html or "").encode()
        name = base64.b32encode(hashlib.sha1(body).digest()).decode()
        again = counts[body] > 1 and body in best and best[body] != page
        out.append((page, len(body), name, "revisit" if again else "response", best[body] if again else None))
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(12)
    out = [(i, "".join(rnd.choices("a<é\r\n日", k=rnd.choice([0, 3, 50, 400, 900])))) for i in range(80)]
    out += [(100 + i, "copy " * 200) for i in range(12)] + [(200, None), (201, ""), (None, "copy " * 200), (None, "lone")]
    return out + [(300, "WARC/1.1\r\n\r\n" * 300), (301, "z" * 100_000), (111, "copy " * 200), (5, "other"), (6, out[6][1])]


@pytest.mark.parametrize("least", [0, 500])
def test_round_trip(spark, rows, least):
    data = [(p, f"http://x/{p}\r\n", h, "s") for p, h in rows]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, sum string").repartition(3)
    with tempfile.TemporaryDirectory() as folder:
        write_archives(pages, folder + "/w", least_bytes=least, segment_bytes=300)
        got = read_pages(spark, folder + "/w").collect()
        kinds = {r.type for r in read_records(spark, folder + "/w").collect()}
    assert kinds == {"response", "revisit", "continuation"}
    assert all(r.intact for r in got)
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(brute(rows, least), key=repr)


def test_broken_segments_are_noticed(spark):
    kinds = "type string, record_id string, target_uri string, payload_digest string, refers_to string, origin_id string, segment long, total long, block binary"
    part = lambda rid, origin, n, total, block: ("response" if n == 1 else "continuation", rid, None, None, None, origin, n, total, block)
    records = spark.createDataFrame(
        [
            part("a", None, 1, None, b"12"), part("a3", "a", 3, 5, b"5"), part("a2", "a", 2, None, b"34"),
            part("b", None, 1, None, b"12"), part("b3", "b", 3, 5, b"5"),
            part("c", None, 1, None, b"12"), part("c2", "c", 2, 9, b"34"),
            part("d2", "d", 2, 2, b"34"),
        ],
        kinds,
    )
    got = {r.record_id: (r.complete, r.block) for r in reassembled(records).collect()}
    assert got.pop("a") == (True, b"12345")
    assert got == {"b": (False, None), "c": (False, None), "d": (False, None)}


def test_empty_table(spark):
    with tempfile.TemporaryDirectory() as folder:
        write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder + "/w")
        assert read_pages(spark, folder + "/w").count() == 0


def test_archives_are_parsed_once(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "x" * (i * 700)) for i in range(40)], "page_id long, url string, html string")
    with tempfile.TemporaryDirectory() as folder:
        write_archives(pages, folder + "/w", segment_bytes=4096)
        got = read_pages(spark, folder + "/w")
        # what is joined and united are narrow rows that were written once, not archives
        assert "FileScan text" not in got._jdf.queryExecution().toString()
        assert {(r.page_id, r.payload_bytes, r.intact) for r in got.collect()} == {(i, i * 700, True) for i in range(40)}
