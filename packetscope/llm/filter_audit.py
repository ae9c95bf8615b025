"""How document filters overlap, from truth-table words and carry-save popcounts.

A document that fails a set of filters survives every subset of filters disjoint from it:
32 subsets of five filters, one bit each, make a 32-bit word. Counting how often each bit is
set among the words of a part gives the survivors of all subsets at once, and from these
follow what every order of the filters keeps and removes at every step.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetscope.llm.common import byte_slices, id_type
from packetscope.session import ship, written

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 3
UPPER, SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
# word of each set of failed filters: bit S is set where subset S holds none of them
SURVIVES = [sum(1 << s for s in range(ALL + 1) if not s & failed) for failed in range(ALL + 1)]
# vectors summed by one tree of adders, and words that are counted bit by bit
ROWS, FEW = 31, 64
# (part, label) pairs a task keeps before it hands their counts on
KEPT = 4096


def failures(text: str) -> int:
    """Filters A to D that a text fails, A in the lowest bit."""
    raw = text.encode()
    words = raw.split()  # bytes split at 09-0D and 20, as asked
    upper = len(raw) - len(raw.translate(None, UPPER))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * upper > UPPER_PERCENT * len(text)) << 2
        | (len(raw) > len(raw.translate(None, SYMBOLS))) << 3
    )


def carry_save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry of three bit vectors, position by position."""
    either = a ^ b
    return either ^ c, (a & b) | (either & c)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set, bit 0 first.

    Carry-save adders turn 31 vectors into five: bit planes of weight 1, 2, 4, 8, 16. Each
    plane is counted in the same way, being a thirty-first as long.
    """
    if len(words) <= FEW:
        bits = np.unpackbits(words.astype("<u4").view(np.uint8), bitorder="little")
        return bits.reshape(-1, 32).sum(0, dtype=np.int64)
    padded = np.zeros(-(-len(words) // ROWS) * ROWS, np.uint32)
    padded[: len(words)] = words
    level, weight, counts = list(padded.reshape(ROWS, -1)), 1, np.zeros(32, np.int64)
    while level:
        carries = []
        while len(level) > 1:
            third = level.pop() if len(level) > 2 else np.zeros_like(level[0])
            total, carry = carry_save(level.pop(), level.pop(), third)
            level.insert(0, total)
            carries.append(carry)
        counts += weight * positional_popcount(level[0])
        level, weight = carries, 2 * weight
    return counts


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id, part, failed`` (filters A to D) and the text's digest; texts stay where they are."""
    spark = docs.sparkSession
    ship(spark)

    def judge(batches):
        for batch in byte_slices(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([failures(t) for t in texts], pa.int32()),
                    pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary()),
                ],
                names=["doc_id", "part", "failed", "digest"],
            )

    rows = docs.select(
        docs["doc_id"], docs["text"], F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("part")
    )
    kind = id_type(rows, "doc_id")
    return rows.mapInArrow(judge, f"doc_id {kind}, part string, failed int, digest binary")


def failed_filters(docs: DataFrame) -> DataFrame:
    """``doc_id, part, failed``: the filters, A in the lowest bit, that each document fails.

    A document is the first of its text if no smaller id has it. Digests stand for texts
    (SHA-256). Which document is first is looked up by digest *and* id, so the copies of one
    text are spread over all tasks however many there are.
    """
    rows = written(judged(docs), "judged")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    is_copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    marked = rows.join(first.withColumn("first", F.lit(True)), ["digest", "doc_id"], "left")
    return marked.select(
        "doc_id", "part", F.col("failed").bitwiseOR(F.when(is_copy, 16).otherwise(0)).alias("failed")
    )


def survivors(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, subset, docs, good, toxic``: documents that survive each subset of filters.

    ``failed`` has the columns of ``failed_filters``. A document is good (toxic) if any of its
    labels has quality 1 (toxic 1).
    """
    label = labels.groupBy("doc_id").agg(
        F.max(F.coalesce(labels["quality"] == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(labels["toxic"] == 1, F.lit(False))).alias("bad"),
    )
    word = F.element_at(F.lit(SURVIVES), F.col("failed") + 1)
    words = failed.join(label, "doc_id", "left").select(
        "part",
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("bad", F.lit(False)).alias("bad"),
        word.cast("long").alias("word"),
    )

    def count(batches):
        sums: dict[tuple, np.ndarray] = {}

        def handed_on():
            keys = list(sums)
            out = pa.RecordBatch.from_pydict(
                {
                    "part": [k[0] for k in keys],
                    "good": [k[1] for k in keys],
                    "bad": [k[2] for k in keys],
                    "n": [sums[k].tolist() for k in keys],
                },
                schema=pa.schema([
                    ("part", pa.string()), ("good", pa.bool_()), ("bad", pa.bool_()), ("n", pa.list_(pa.int64()))
                ]),
            )
            sums.clear()
            return out

        for batch in batches:
            frame = batch.to_pandas()
            for key, group in frame.groupby(["part", "good", "bad"])["word"]:
                counted = positional_popcount(group.to_numpy().astype(np.uint32))
                sums[key] = sums[key] + counted if key in sums else counted
            if len(sums) > KEPT:
                yield handed_on()
        yield handed_on()

    counts = words.mapInArrow(count, "part string, good boolean, bad boolean, n array<long>")
    bits = counts.select("part", "good", "bad", F.posexplode("n").alias("subset", "n"))
    return bits.groupBy("part", "subset").agg(
        F.sum("n").alias("docs"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def audit(survived: DataFrame) -> DataFrame:
    """Every order of the filters, step by step, from the survivors of all subsets.

    The 600 rows of a part come from its own 32 counts. ``shapley`` adds up what the step's
    filter removes in all 120 orders.
    """
    tables = survived.groupBy("part").agg(
        F.sort_array(F.collect_list(F.struct("subset", "docs", "good", "toxic"))).alias("t")
    )
    orders = F.lit(["".join(p) for p in permutations(FILTERS)])
    steps = (
        tables.select("part", "t", F.explode(orders).alias("filter_order"))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
        .withColumn("letters", F.split("filter_order", ""))
        .select(
            "part",
            "filter_order",
            "step",
            "t",
            F.expr("shiftleft(1, ascii(letters[step - 1]) - 65)").alias("own"),
            F.expr(
                "aggregate(slice(letters, 1, step - 1), 0, (s, c) -> s | shiftleft(1, ascii(c) - 65))"
            ).alias("before"),
        )
    )

    def left(subset: Column, of: str = "docs") -> Column:
        return F.element_at("t", subset + 1)[of]

    own, before = F.col("own"), F.col("before")
    after, others = before.bitwiseOR(own), F.lit(ALL) - own

    def lost(of: str) -> Column:
        return left(before, of) - left(after, of)

    fails = left(F.lit(0)) - left(own)
    return steps.select(
        "part",
        "filter_order",
        "step",
        left(after).alias("kept"),
        lost("docs").alias("removed"),
        (fails - lost("docs")).alias("redundant"),
        (left(others) - left(F.lit(ALL))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.sum(lost("docs")).over(W.partitionBy("part", "own")).alias("shapley"),
    )


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Audit five filters over whole texts: ``part, filter_order, step`` and counts.

    Null texts are empty ones; null and empty ``lang`` make the part ''. Very long texts are
    read whole, a few megabytes of texts at a time. Repeated rows count each; they are copies
    of no *smaller* id and so pass E, unless another row has their text under one. Rows
    without an id never fail E, are nobody's original, and carry no label. Several labels of
    an id count as in ``survivors``; labels of unknown ids are not used. Columns beyond those
    named are not read. An empty table has no parts and gives no rows.
    """
    return audit(survivors(failed_filters(docs), labels))
