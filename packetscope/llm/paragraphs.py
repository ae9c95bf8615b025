"""Repeated passages: paragraphs that are alike across or within documents.

A paragraph is a line, cut further at ends of sentences that the last words of neighbouring
sentences choose, so that a passage copied into other surroundings falls into the same
paragraphs there. MinHash bands, tuned for recall, propose pairs of different paragraphs, exact
Jaccard similarities decide, links become classes, and each class keeps its first
occurrence.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetscope.llm.common import byte_slices, giving_back, id_and_text, id_type
from packetscope.llm.cutting import AT_ONCE, Texts, shingled
from packetscope.llm.linking import BLOCKS, classes_of_sets, dealt, parts_for, repeated_blocks
from packetscope.llm.shingles import WORDS as SHINGLE
from packetscope.llm.shingles import bands_of, counted, mixed, tuned
from packetscope.session import ship, written

SIMILARITY = 0.8
# paragraphs of fewer words are never removed
LEAST_WORDS = 8
# of so many ends of sentences in a row at least one ends a paragraph
CUT = 2
# components of a signature at most; unrelated paragraphs hardly share a shingle, so few do
_COMPONENTS = 20
_ODD, _HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)


def paragraphs_of(text: str, cut: int = CUT) -> list[tuple[int, int]]:
    """Where paragraphs start and end, without the white space between them.

    White space with a new line in it, or at the end of the text, ends a line; other white
    space after a mark ends a sentence. Of every ``cut`` ends of sentences in a row within a
    line, the one whose last word has the least hash ends a paragraph. Only neighbours
    decide, so a passage of some sentences has such ends wherever it stands.
    """
    texts = Texts(pa.array([text], pa.string()))
    _, _, begin, end, _ = texts.paragraphs(cut)
    return list(zip((texts.points(begin) - 1).tolist(), (texts.points(end) - 1).tolist()))


class Signer:
    """Paragraphs of texts with hashes, bands and shingles, on a worker."""

    def __init__(self, similarity: float, least_words: int):
        self.bands, self.rows = tuned(similarity, most=_COMPONENTS)
        self.least_words = least_words
        size = self.bands * self.rows
        seeds = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        self.seeds = mixed(seeds) | np.uint64(1)

    def __call__(self, texts: Texts):
        """Owners, spans, hashes, bands, shingles and how many, of all long paragraphs."""
        *paragraphs, inside = texts.paragraphs(CUT)
        first, last = texts.words(inside)
        # every word lies in a paragraph
        sizes = np.diff(np.append(np.searchsorted(first, paragraphs[2]), len(first)))
        long = sizes >= max(1, self.least_words)
        words = np.repeat(long, sizes)
        sizes, paragraphs = sizes[long], [p[long] for p in paragraphs]
        hashed = texts.hashes(first[words], last[words])
        values, counts = shingled(hashed, sizes, SHINGLE)
        signature = np.empty((len(sizes), len(self.seeds)), np.uint64)
        short = np.zeros(len(sizes), np.int64)
        if len(sizes):
            starts, at = np.cumsum(sizes) - sizes, np.cumsum(counts) - counts
            place = np.arange(len(hashed)) - np.repeat(starts, sizes)
            sums = np.add.reduceat(mixed(hashed + place.astype(np.uint64) * _ODD), starts)
            short = mixed(sums + sizes.astype(np.uint64)).view(np.int64)
            scratch, upper = np.empty_like(values), np.empty_like(values)
            for i, seed in enumerate(self.seeds):
                # the values are spread already, so two products are enough
                np.multiply(values, seed, out=scratch)
                np.right_shift(scratch, _HALF, out=upper)
                np.bitwise_xor(scratch, upper, out=scratch)
                np.multiply(scratch, _ODD, out=scratch)
                signature[:, i] = np.minimum.reduceat(scratch, at)
        return *paragraphs, short, bands_of(signature, self.rows), values, counts


def _hashes(texts: DataFrame, similarity: float, least_words: int) -> DataFrame:
    """Every band with its paragraph's hash, every such hash with its occurrence, in blocks."""
    parts = parts_for(texts)

    def pairs(batches):
        sign = Signer(similarity, least_words)
        for batch in byte_slices(batches, 1, AT_ONCE):
            owners, places, _, _, short, bands, _, _ = sign(Texts(batch.column(1)))
            row = np.asarray(batch.column(2))[owners].astype(np.uint64)
            once = mixed(mixed(row) + places.astype(np.uint64)).view(np.int64)
            # a paragraph of this slice that comes again hands its bands on once
            _, first = np.unique(short, return_index=True)
            yield np.concatenate([bands[first].ravel(), short]), np.concatenate([np.repeat(short[first], sign.bands), once])

    # any number that tells rows apart
    row = F.monotonically_increasing_id().alias("row")
    return texts.select("doc_id", "text", row).mapInArrow(
        giving_back(lambda batches: dealt(pairs(batches), parts)), BLOCKS
    )


def _found(texts: DataFrame, similarity: float, least_words: int, shared) -> DataFrame:
    """The paragraphs that occur again, or that share a band with another one."""

    def run(batches):
        sign, again = Signer(similarity, least_words), shared.value
        for batch in byte_slices(batches, 1, AT_ONCE):
            all_texts = Texts(batch.column(1))
            owners, places, begin, end, short, bands, values, counts = sign(all_texts)
            hit = again.has(bands)
            near = hit.any(axis=1) if len(hit) else np.zeros(0, bool)
            take = np.flatnonzero(near | again.has(short))
            owners, near, hit, bands = owners[take], near[take], hit[take], bands[take]
            before = all_texts.points(all_texts.begins[owners])
            spans = zip(begin[take].tolist(), end[take].tolist())
            keys = [hashlib.md5(b" ".join(all_texts.lower[a:b].split())).digest() for a, b in spans]
            # distinct shingles of those that share a band
            size = np.where(near, counts[take], 0)
            at = np.repeat((np.cumsum(counts) - counts)[take] - np.cumsum(size) + size, size) + np.arange(size.sum())
            distinct, of, _ = counted(values[at], np.repeat(np.arange(len(take)), size))
            cuts = np.searchsorted(of, np.arange(len(take) + 1)).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(owners, pa.int64())),
                    pa.array(places[take].astype(np.int32)),
                    *(
                        pa.array((all_texts.points(side[take]) - before).astype(np.int32))
                        for side in (begin, end)
                    ),
                    pa.array(keys, pa.binary()),
                    pa.array([b[h].tolist() if n else None for b, h, n in zip(bands, hit, near)], pa.list_(pa.int64())),
                    pa.array(
                        [distinct[a:b].tobytes() if n else None for a, b, n in zip(cuts, cuts[1:], near)], pa.binary()
                    ),
                ],
                names=["doc_id", "place", "start", "end", "key", "bands", "values"],
            )

    kind = id_type(texts, "doc_id")
    return texts.mapInArrow(
        giving_back(run),
        f"doc_id {kind}, place int, start int, end int, key binary, bands array<long>, values binary",
    )


def repeated_paragraphs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """``doc_id, place, start, end, class_doc_id, class_place, removed``: each paragraph that
    is like another, once per occurrence.

    ``start`` and ``end`` are code points of the text, ``place`` counts its paragraphs
    from 0. A class is what links connect; links are equal words and a Jaccard similarity
    of five-word shingles of at least ``similarity``. ``class_doc_id, class_place`` name its
    first occurrence by id and place, which alone is not ``removed``; null ids come last,
    and of rows that repeat whole the class's first stays in each. Paragraphs of fewer than
    ``least_words`` words never appear, so null, empty and wordless texts have none. Other
    columns are not read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = id_and_text(docs, id_col, text_col)
    again, _ = repeated_blocks(_hashes(texts, similarity, least_words))
    found = written(
        _found(texts, similarity, least_words, spark.sparkContext.broadcast(again)), "paragraphs"
    )
    near = found.where("values IS NOT NULL").select("key", F.col("bands").alias("buckets"), "values")
    linked = classes_of_sets(near, similarity)
    spans = found.select("doc_id", "place", "start", "end", "key").join(linked, "key", "left")
    spans = spans.withColumn("root", F.coalesce("root", "key")).drop("key")
    first = (
        spans.groupBy("root")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("first"),
        )
        .where("n > 1")
    )
    every = spans.join(first, "root").select(
        "doc_id", "place", "start", "end",
        F.col("first.doc_id").alias("class_doc_id"), F.col("first.place").alias("class_place"),
    )
    kept = F.col("doc_id").eqNullSafe(F.col("class_doc_id")) & (F.col("place") == F.col("class_place"))
    return every.withColumn("removed", ~kept)
