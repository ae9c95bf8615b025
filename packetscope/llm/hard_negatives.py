"""Hard negatives by exact search over blocks with zone maps.

Candidates lie along a Hilbert curve, cut into blocks: one Parquet row each, with the least
and greatest value of every dimension beside the packed rows. Interval arithmetic over these
zones bounds the score of every row of a block, so an anchor opens only the blocks that can
hold a row of one of its score windows. Anchors come in chunks of bounded size; each chunk is
broadcast and meets the blocks where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetscope.llm.hilbert import cells_of, hilbert_keys, projection
from packetscope.plans.ordered import number_rows
from packetscope.session import scratch_path, ship, written

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
# rows of a block, blocks of a shelf (a partition folder), bytes of anchors sent at one time
BLOCK, SHELF, CHUNK_BYTES = 1024, 64, 8 << 20
# anchors whose bounds and scores are worked out together
TOGETHER = 256
# products and sums of doubles are exact below; places in a block need BLOCK times as much
_EXACT, _LOW = 2.0**53, -np.iinfo(np.int64).max
_FORMS = ("<i2", "<i4", "<f8")


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, embedding`` without rows that take no part.

    Left out are null ids and labels and vectors that are null, empty, hold a null or
    non-finite component, or have another length than most (of equal counts the shortest).
    """
    x = vectors.select(
        vectors["vec_id"].cast("long").alias("vec_id"),
        vectors["label"].cast("long").alias("label"),
        vectors["embedding"].cast("array<double>").alias("embedding"),
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0")
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = x.where(~bad)
    sizes = good.groupBy(F.size("embedding").alias("n")).count()
    usual = sizes.orderBy(F.desc("count"), "n").limit(1).collect()
    return good.where(F.size("embedding") == F.lit(usual[0]["n"] if usual else 0))


def _whole(values: list) -> np.ndarray:
    return np.floor(SCALE * np.array(values, np.float64))


def _packed(values: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers in the narrowest form that holds them."""
    most = np.abs(values).max(initial=0)
    form = 0 if most < 2**15 else 1 if most < 2**31 else 2
    return form, values.astype(_FORMS[form]).tobytes()


def _unpacked(form: int, raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, _FORMS[form]).reshape(rows, -1).astype(np.float64)


def with_keys(rows: DataFrame) -> DataFrame:
    """Add the Hilbert ``key`` of each whole-numbered vector."""

    def key(batches):
        directions = None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _whole(batch.column(2).to_pylist())
            if directions is None:
                directions = projection(values.shape[1]).astype(np.float64)
            largest = np.maximum(np.abs(values).max(1, keepdims=True), 1)
            scaled = np.rint(values / largest * 4096)  # sums stay exact whatever the values
            keys = hilbert_keys(cells_of(scaled @ directions, (scaled * scaled).sum(1)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(keys)], names=["vec_id", "label", "embedding", "key"]
            )

    return rows.mapInArrow(key, "vec_id long, label long, embedding array<double>, key long")


_BLOCKS = (
    "shelf int, block long, rows int, zone_form int, low binary, high binary, labels binary, "
    "form int, ids binary, values binary, of binary"
)


def blocks_of(keyed: DataFrame, block: int = BLOCK, shelf: int = SHELF) -> DataFrame:
    """Blocks along the curve as a table in the shared folder, one folder per shelf.

    Equal keys are split by id, so a vector that a third of the rows share fills blocks of
    its own on many shelves.
    """
    spark = keyed.sparkSession
    shelves = max(1, -(-keyed.count() // (block * shelf)))

    def pack(batches):
        here = TaskContext.get().partitionId()
        number = here << 32

        def packed(rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            ids = rows.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            values = _whole(rows.column("embedding").to_pylist())[order]
            labels = rows.column("label").to_numpy()[order]
            form, raw = _packed(values)
            low, high = values.min(0), values.max(0)
            zone_form, zone = _packed(np.stack([low, high]))
            half = len(zone) // 2
            number += 1
            return pa.RecordBatch.from_pydict({
                "shelf": pa.array([here], pa.int32()),
                "block": pa.array([number], pa.int64()),
                "rows": pa.array([len(ids)], pa.int32()),
                "zone_form": pa.array([zone_form], pa.int32()),
                "low": pa.array([zone[:half]], pa.binary()),
                "high": pa.array([zone[half:]], pa.binary()),
                "labels": pa.array([np.unique(labels).tobytes()], pa.binary()),
                "form": pa.array([form], pa.int32()),
                "ids": pa.array([ids[order].tobytes()], pa.binary()),
                "values": pa.array([raw], pa.binary()),
                "of": pa.array([labels.tobytes()], pa.binary()),
            })

        waiting: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            waiting.append(batch)
            held += batch.num_rows
            if held >= block:
                table = pa.Table.from_batches(waiting)
                whole = held // block * block
                for start in range(0, whole, block):
                    yield packed(table.slice(start, block))
                waiting, held = table.slice(whole).to_batches(), held - whole
        if held:
            yield packed(pa.Table.from_batches(waiting))

    ranged = keyed.repartitionByRange(shelves, "key", "vec_id").sortWithinPartitions("key", "vec_id")
    path = scratch_path(spark, "blocks")
    ranged.mapInArrow(pack, _BLOCKS).write.partitionBy("shelf").parquet(path)
    return spark.read.schema(_BLOCKS).parquet(path)


class _Chunk:
    """Anchors of one chunk and what is known of each so far; sent to all tasks."""

    def __init__(self, number: np.ndarray, ids: np.ndarray, labels: np.ndarray, values: np.ndarray):
        self.number, self.ids, self.labels, self.values = number, ids, labels, values
        self.most = np.abs(values).max(1) if values.size else np.zeros(len(values))
        # rows of one label: least score worth looking at
        self.least = np.full(len(ids), _LOW, np.int64)
        # other labels: lowest and highest score of each window, with the positive it is for
        self.low = self.high = self.positive = self.score = np.zeros((len(ids), 0), np.int64)

    def bounds(self, rows: slice, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that a row between ``low`` and ``high`` can have.

        Rounding only occurs beyond 2**53; there the bounds are widened past it.
        """
        up, down = np.maximum(self.values[rows], 0), np.minimum(self.values[rows], 0)
        upper, lower = up @ high + down @ low, up @ low + down @ high
        size = np.abs(self.values[rows]) @ np.maximum(np.abs(low), np.abs(high))
        slack = np.where(size < _EXACT, 0, size * 1e-12)
        return lower - slack, upper + slack


def _scores(chunk: _Chunk, need: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Exact scores of anchors against the rows of a block."""
    anchors = chunk.values[need]
    if chunk.most[need].max() * np.abs(values).max(initial=0) * values.shape[1] < _EXACT:
        return (anchors @ values.T).astype(np.int64)
    exact = np.array([[int(v) for v in a] for a in anchors], object) @ np.array(
        [[int(v) for v in r] for r in values], object
    ).T
    if any(not -(2**62) < v < 2**62 for v in exact.ravel()):
        raise OverflowError("a score does not fit 64 bits")
    return exact.astype(np.int64)


class _Best:
    """The k best (score, id) of every anchor and slot that a task has seen."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.score = np.full((anchors, slots, k), _LOW, np.int64)
        self.id = np.zeros((anchors, slots, k), np.int64)

    def add(self, need: np.ndarray, slot: int, scores: np.ndarray, wanted: np.ndarray, ids: np.ndarray):
        """Rows come by ascending id; unwanted ones are left out, ties go to the smaller id."""
        k, n = self.score.shape[2], scores.shape[1]
        masked = np.where(wanted, scores, _LOW)
        if n > k:
            # what reaches the k-th best score, the first k by place where more tie
            edge = np.partition(masked, n - k, axis=1)[:, n - k, None]
            above = masked > edge
            level = (masked == edge) & wanted
            room = k - above.sum(1, keepdims=True)
            taken = above | (level & (np.cumsum(level, axis=1) <= room))
        else:
            taken = wanted
        row, column = np.nonzero(taken & wanted)
        place = np.cumsum(taken & wanted, axis=1)[row, column] - 1
        score = np.full((len(need), 2 * k), _LOW, np.int64)
        name = np.zeros((len(need), 2 * k), np.int64)
        score[:, :k], name[:, :k] = self.score[need, slot], self.id[need, slot]
        score[row, k + place], name[row, k + place] = scores[row, column], ids[column]
        order = np.lexsort((name, -score), axis=1)[:, :k]
        self.score[need, slot] = np.take_along_axis(score, order, 1)
        self.id[need, slot] = np.take_along_axis(name, order, 1)


def _needed(chunk: _Chunk, zone: dict, rows: slice, best: _Best | None) -> np.ndarray:
    """Which anchors must open a block, by its zones alone."""
    low = _unpacked(zone["zone_form"], zone["low"], 1)[0]
    high = _unpacked(zone["zone_form"], zone["high"], 1)[0]
    lower, upper = chunk.bounds(rows, low, high)
    if chunk.low.shape[1]:
        least = chunk.low[rows]
        if best is not None:
            least = np.maximum(least, best.score[rows, :, -1])
        return ((upper[:, None] >= least) & (lower[:, None] <= chunk.high[rows])).any(1)
    least = chunk.least[rows]
    if best is not None:
        least = np.maximum(least, best.score[rows, 0, -1])
    held = np.isin(chunk.labels[rows], np.frombuffer(zone["labels"], np.int64))
    return held & (upper >= least)


def _opened(
    chunk: _Chunk, batches: Iterator[pa.RecordBatch], k: int, near: bool = False
) -> Iterator[pa.RecordBatch]:
    """Meet the blocks of one task: positives, or the negatives of every window.

    ``near``: only the blocks whose zones hold the anchor itself.
    """
    windows = chunk.low.shape[1]
    best = _Best(len(chunk.ids), max(1, windows), k)
    for batch in batches:
        for block in batch.to_pylist():
            values = ids = None
            for start in range(0, len(chunk.ids), TOGETHER):
                rows = slice(start, start + TOGETHER)
                if near:
                    low = _unpacked(block["zone_form"], block["low"], 1)[0]
                    high = _unpacked(block["zone_form"], block["high"], 1)[0]
                    held = chunk.values[rows]
                    wanted = ((held >= low) & (held <= high)).all(1)
                else:
                    wanted = _needed(chunk, block, rows, best)
                need = start + np.flatnonzero(wanted)
                if not len(need):
                    continue
                if values is None:
                    values = _unpacked(block["form"], block["values"], block["rows"])
                    ids = np.frombuffer(block["ids"], np.int64)
                    labels = np.frombuffer(block["of"], np.int64)
                scores = _scores(chunk, need, values)
                same = chunk.labels[need, None] == labels
                if not windows:
                    best.add(need, 0, scores, same & (chunk.ids[need, None] != ids), ids)
                for slot in range(windows):
                    inside = (scores >= chunk.low[need, slot, None]) & (scores <= chunk.high[need, slot, None])
                    best.add(need, slot, scores, inside & ~same, ids)
    anchor, slot, place = np.nonzero(best.score > _LOW)
    for at in range(0, len(anchor), 8192):
        a, s, p = (x[at : at + 8192] for x in (anchor, slot, place))
        columns = {"anchor": chunk.number[a], "anchor_id": chunk.ids[a], "slot": s.astype(np.int64)}
        if windows:
            columns |= {"positive_id": chunk.positive[a, s], "positive_score": chunk.score[a, s]}
        columns |= {"id": best.id[a, s, p], "score": best.score[a, s, p]}
        yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in columns.items()})


_POSITIVE = "anchor long, anchor_id long, slot long, id long, score long"
_NEGATIVE = (
    "anchor long, anchor_id long, slot long, positive_id long, positive_score long, id long, score long"
)


def _search(blocks: DataFrame, chunk: _Chunk, kind: str, k: int, near: bool = False) -> DataFrame:
    """The k best of every anchor and slot over all blocks."""
    sent = blocks.sparkSession.sparkContext.broadcast(chunk)
    found = blocks.mapInArrow(lambda batches: _opened(sent.value, batches, k, near), kind)
    best = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _shelves(blocks: DataFrame, chunk: _Chunk) -> DataFrame:
    """The blocks on shelves where some zone can matter; the other folders are not read.

    Only zones are read to find out. The list has at most one entry per shelf folder.
    """
    sent = blocks.sparkSession.sparkContext.broadcast(chunk)

    def ask(batches):
        for batch in batches:
            shelves = set()
            for zone in batch.to_pylist():
                slices = (slice(at, at + TOGETHER) for at in range(0, len(sent.value.ids), TOGETHER))
                if any(_needed(sent.value, zone, rows, None).any() for rows in slices):
                    shelves.add(zone["shelf"])
            yield pa.RecordBatch.from_pydict({"shelf": pa.array(sorted(shelves), pa.int32())})

    zones = blocks.select("shelf", "zone_form", "low", "high", "labels")
    wanted = [r["shelf"] for r in zones.mapInArrow(ask, "shelf int").distinct().collect()]
    return blocks.where(F.col("shelf").isin(wanted)) if wanted else blocks.where("false")


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = (50, 95),
    block: int = BLOCK,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """For each anchor and each of its positives, the best rows of other labels in a window.

    ``vectors`` has ``vec_id``, an integer ``label`` and ``embedding``; ``is_anchor`` is a
    condition on ``vec_id`` or ``label``. Components become ``floor(256 x)``; scores are exact
    whole inner products, higher ones first, ties by smaller id. Positives are an anchor's
    first rows of its label. Negatives of a positive score between ``window`` per cent of it.
    Returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Rows that take no part are named in ``usable``. Rows with an anchor's id are the anchor,
    never its candidates; other repeated rows count each, and a repeated anchor is answered
    each time. Where fewer rows qualify, all are returned; a negative positive score has an
    empty window. Other columns are not read. An empty table gives no rows. Scores beyond
    62 bits raise an error.
    """
    spark = vectors.sparkSession
    ship(spark)
    keyed = written(with_keys(usable(vectors)), "keyed")
    blocks = blocks_of(keyed, block)
    asked = number_rows(keyed.where(is_anchor), [F.col("key"), F.col("vec_id"), F.col("label")], "anchor")
    size = asked.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    step = max(1, chunk_bytes // (8 * (size[1] or 1)))
    low, high = window
    path = scratch_path(spark, "negatives")
    spark.createDataFrame([], _NEGATIVE + ", rank int").write.parquet(path)
    for start in range(1, size[0] + 1, step):
        part = asked.where(F.col("anchor").between(start, start + step - 1)).orderBy("anchor").toArrow()
        chunk = _Chunk(
            part["anchor"].to_numpy(),
            part["vec_id"].to_numpy(),
            part["label"].to_numpy(),
            _whole(part["embedding"].to_pylist()),
        )
        # blocks around the anchors give each a score its positives cannot fall below
        seeds = _search(blocks, chunk, _POSITIVE, positives, near=True).where(F.col("rank") == positives)
        for row in seeds.select("anchor", "score").collect():
            chunk.least[row["anchor"] - start] = row["score"]
        found = _search(_shelves(blocks, chunk), chunk, _POSITIVE, positives).collect()
        shape = (len(chunk.ids), positives)
        chunk.positive, chunk.score = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        chunk.low, chunk.high = np.ones(shape, np.int64), np.zeros(shape, np.int64)
        for row in found:
            at, score = (row["anchor"] - start, row["rank"] - 1), row["score"]
            chunk.positive[at], chunk.score[at] = row["id"], score
            chunk.low[at], chunk.high[at] = -(-low * score // 100), high * score // 100
        picked = _search(_shelves(blocks, chunk), chunk, _NEGATIVE, negatives)
        picked.write.mode("append").parquet(path)
    return spark.read.schema(_NEGATIVE + ", rank int").parquet(path).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
