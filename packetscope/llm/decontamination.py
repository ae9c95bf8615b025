"""Benchmark decontamination by Wu-Manber search over words.

The patterns are all runs of consecutive words of the benchmark items. A table over
blocks of two words says how far the search may jump; where it may not, the block's
bucket gives the patterns to compare directly.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetscope.llm.common import id_and_text, text_udf, words_of
from packetscope.session import ship

# words in a window, and bytes of items one broadcast may hold; more items take more passes
WINDOW, PASS_BYTES = 10, 32 << 20


class WuManber:
    """Finds patterns of one length, in words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[int]], length: int):
        self.length, self.block = length, min(2, length)
        self.longest_shift = length - self.block + 1
        self.shifts: dict[bytes, int] = {}
        # last block -> first block -> patterns: the first block is a cheap second look
        self.buckets: dict[bytes, dict[bytes, list]] = {}
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                key = b" ".join(words[end - self.block : end])
                self.shifts[key] = min(self.shifts.get(key, length), length - end)
            last, first = (b" ".join(w) for w in (words[-self.block :], words[: self.block]))
            self.buckets.setdefault(last, {}).setdefault(first, []).append((words, items))

    def search(self, words: list[bytes]):
        """Yields where each occurrence starts and the items it belongs to."""
        length, block, n = self.length, self.block, len(words)
        get, far, buckets = self.shifts.get, self.longest_shift, self.buckets
        at = length - 1
        while at < n:
            key = words[at - 1] + b" " + words[at] if block == 2 else words[at]
            shift = get(key, far)
            if shift:
                at += shift
                continue
            start = at - length + 1
            first = b" ".join(words[start : start + block])
            for pattern, items in buckets[key].get(first, ()):
                if tuple(words[start : at + 1]) == pattern:
                    yield start, items
            at += 1


class Matcher:
    """Looks up all windows of some items in texts."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        patterns: dict[int, dict[tuple, set[int]]] = {}
        for number, (_, text) in enumerate(items):
            words = words_of(text)
            length = min(window, len(words))
            for start in range(len(words) - length + 1 if words else 0):
                same = patterns.setdefault(length, {})
                same.setdefault(tuple(words[start : start + length]), set()).add(number)
        self.searches = [WuManber(p, length) for length, p in sorted(patterns.items())]

    def __call__(self, texts: list[str]) -> list[dict]:
        return [self._one(words_of(text)) for text in texts]

    def _one(self, words: list[bytes]) -> dict:
        spans, items = [], set()
        for search in self.searches:
            for start, found in search.search(words):
                spans.append((start, start + search.length))
                items |= found
        return {
            "n_words": len(words),
            "hits": [{"start": a, "end": b} for a, b in united(spans)],
            "items": sorted({self.names[i] for i in items}),
        }


def united(spans) -> list[tuple[int, int]]:
    """Spans as few that neither touch nor overlap."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


_KIND = "struct<n_words long, hits array<struct<start int, end int>>, items array<string>>"
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("hits", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def _item_groups(benchmark: DataFrame, item_col: str, text_col: str, most: int):
    """The items in groups of at most ``most`` bytes of text each (a longer item is alone)."""
    items = benchmark.select(
        benchmark[item_col].cast("string").alias("item"), benchmark[text_col].alias("text")
    ).where("item IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-2 * size // most))
    for group in range(groups):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == group)
        yield [tuple(r) for r in part.distinct().collect()]


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    pass_bytes: int = PASS_BYTES,
) -> Column:
    """A struct for each text: number of words, hit word ranges, items found.

    The benchmark is broadcast in groups of bounded size, usually one; each further group
    is one more search over the text where it lies.
    """
    spark = docs.sparkSession
    ship(spark)
    found = []
    for items in _item_groups(benchmark, item_col, item_text_col, pass_bytes):
        shared = spark.sparkContext.broadcast(items)
        worker = lambda shared=shared: Matcher(shared.value, window)
        found.append(text_udf(_KIND, _ARROW, worker)(docs[text_col]))
    if len(found) == 1:
        return found[0]
    return F.struct(
        found[0]["n_words"].alias("n_words"),
        _united(F.flatten(F.array(*[f["hits"] for f in found]))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.array(*[f["items"] for f in found])))).alias("items"),
    )


def _united(hits: Column) -> Column:
    """Word ranges that may overlap, as few that don't."""
    empty = F.array().cast("array<struct<start int, end int>>")

    def add(done, hit):
        last = F.try_element_at(done, F.lit(-1))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], hit["end"]).alias("end"))
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(wider))
        return F.when(hit["start"] <= last["end"], joined).otherwise(F.concat(done, F.array(hit)))

    return F.aggregate(F.array_sort(hits), empty, add)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    **options,
) -> DataFrame:
    """``doc_id, n_words, hits, items``: the benchmark's words in every whole text, a row per row.

    ``items`` are item ids as strings, sorted. Null and empty texts have no words. Items
    with a null id or text take no part; equal items are one. Repeated rows and null ids
    come back as they are; other columns are not read; empty tables are fine on either
    side.
    """
    texts = id_and_text(docs, id_col, text_col)
    found = find_passages(texts, benchmark, **options)
    return texts.select("doc_id", found.alias("found")).select("doc_id", "found.*")


def digests(found: DataFrame) -> DataFrame:
    """Counts, and a checksum of the items found."""
    covered = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    return found.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
