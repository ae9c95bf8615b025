"""Approximate nearest neighbours: a graph by NN-descent, and greedy search on it.

The graph starts from blocks of vectors that lie on the same sides of random planes. In
each round every node brings its neighbours, and some of those it is a neighbour of,
together; they meet there as neighbours of neighbours, and each keeps its best. Rounds are
Spark joins; vectors travel as half-precision units. A query walks the graph from its start
towards ever nearer nodes; what it has found is scored exactly at the end.

Equal vectors are one node, so a vector with any number of copies is one point of the
graph.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetscope.llm.common import slices
from packetscope.llm.linking import drop_tables
from packetscope.session import ship, written

# neighbours of a node
DEGREE = 20
# planes in a set, nodes compared in a block, neighbours a block and a meeting propose
_PLANES, _BLOCK, _PROPOSED = 24, 1024, 4
# the part of its best nodes that a query looks at in one step
_WIDE = 4
# a round that changes a smaller share of the edges ends the descent
_CHANGED = 0.01


def tables_for(count: int) -> int:
    """Sets of random planes: more for more nodes, as a block holds a smaller share of them."""
    return max(32, 8 * math.ceil(math.log2(max(count, _BLOCK) / _BLOCK)))


def beam_for(count: int) -> int:
    """Best nodes a query keeps."""
    return 16 * max(4, math.ceil(math.log2(max(count, 2))))


def usable(vector: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector`` of the rows that take part, a row per id."""
    rows = vectors.select(
        vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("vector")
    ).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("size")).count()
    common = sizes.orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    size = common[0]["size"] if common else 0
    return rows.where(F.size("vector") == size).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _units():
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for vector in batch:
                v = np.asarray(vector.as_py(), np.float64)
                v = v / np.abs(v).max()
                out.append((v / np.linalg.norm(v)).astype(np.float16).tobytes())
            yield pa.array(out, pa.binary())

    return F.arrow_udf(run, "binary")


def _nodes(rows: DataFrame, copies: int) -> DataFrame:
    """A row per distinct vector: ``node`` (its smallest id), its smallest ids, vector, unit."""
    rank = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
    first = rows.withColumn("rank", rank).where(F.col("rank") <= copies)
    grouped = first.groupBy("vector").agg(
        F.min("vec_id").alias("node"), F.array_sort(F.collect_list("vec_id")).alias("ids")
    )
    return written(grouped.withColumn("unit", _units()("vector")), "nodes")


def _matrix(units: pa.BinaryArray) -> np.ndarray:
    if not len(units):
        return np.zeros((0, 0), np.float32)
    joined = b"".join(u.as_py() for u in units)
    return np.frombuffer(joined, np.float16).reshape(len(units), -1).astype(np.float32)


def _best_in(ids: np.ndarray, units: np.ndarray, most: int):
    """For each row of a block its ``most`` most similar others."""
    near = units @ units.T
    np.fill_diagonal(near, -np.inf)
    most = min(most, len(ids) - 1)
    if most < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    at = np.argpartition(-near, most - 1, axis=1)[:, :most]
    return np.repeat(ids, most), ids[at].ravel(), np.take_along_axis(near, at, axis=1).ravel()


_EDGE = ["node", "other", "near"]


def _edges(parts) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3
    kinds = (pa.int64(), pa.int64(), pa.float32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_EDGE)


def _first_edges(nodes: DataFrame, count: int) -> DataFrame:
    """Neighbours within blocks of nodes, in the order of the sides of planes they lie on.

    Each set of planes orders all nodes anew. Ties are broken by a hash, so a crowd on the
    same sides is cut into blocks like any other.
    """
    tables = tables_for(count)

    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = 1 << np.arange(_PLANES)[::-1]
        planes = None
        for batch in batches:
            codes = []
            units = _matrix(batch)
            if len(units) and planes is None:
                size = (units.shape[1], tables * _PLANES)
                planes = np.random.default_rng(17).normal(size=size).astype(np.float32)
            if len(units):
                sides = (units @ planes > 0).reshape(len(units), tables, _PLANES)
                codes = (sides * weights).sum(axis=2).tolist()
            yield pa.array(codes, pa.list_(pa.int64()))

    def run(batches):
        at, ids, units = None, [], []
        for batch in slices(batches, _BLOCK):
            for table, node, unit in zip(*(c.to_pylist() for c in batch.columns)):
                if table != at or len(ids) == 2 * _BLOCK:
                    keep = len(ids) - _BLOCK if table == at else 0
                    if ids:
                        yield block(ids[: len(ids) - keep], units[: len(ids) - keep])
                    ids, units, at = ids[len(ids) - keep :], units[len(ids) - keep :], table
                ids.append(node)
                units.append(unit)
        if ids:
            yield block(ids, units)

    def block(ids, units):
        near = _matrix(pa.array(units, pa.binary()))
        return _edges([_best_in(np.asarray(ids, np.int64), near, _PROPOSED)])

    codes = F.arrow_udf(coded, "array<long>")("unit")
    placed = nodes.select("node", "unit", F.xxhash64("node").alias("salt"), F.posexplode(codes).alias("table", "code"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(parts, count * tables // (4 * _BLOCK)))  # blocks end where a partition ends
    order = ["table", "code", "salt"]
    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ordered.select("table", "node", "unit").mapInArrow(run, "node long, other long, near float")


def _best(edges: DataFrame, degree: int) -> DataFrame:
    """The best distinct edges of every node; all but a node's best leave before the shuffle."""
    once = edges.groupBy("node", "other").agg(F.max("near").alias("near"), F.max("old").alias("old"))
    rank = F.row_number().over(W.partitionBy("node").orderBy(F.desc("near"), "other"))
    return once.withColumn("rank", rank).where(F.col("rank") <= degree).drop("rank")


def _around(edges: DataFrame, degree: int, number: int) -> DataFrame:
    """Each node's neighbours, and as many at most that it is a neighbour of."""
    back = edges.select(F.col("other").alias("node"), F.col("node").alias("other"))
    order = F.xxhash64("other", F.lit(number))
    rank = F.row_number().over(W.partitionBy("node").orderBy(order, "other"))
    some = back.withColumn("rank", rank).where(F.col("rank") <= degree).drop("rank")
    return edges.select("node", "other").union(some).distinct()


def _with_units(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lists of ``other, unit`` by node."""
    units = nodes.select(F.col("node").alias("other"), "unit")
    return pairs.join(units, "other").groupBy("node").agg(F.collect_list(F.struct("other", "unit")).alias("around"))


def _meet(lists: DataFrame, most: int) -> DataFrame:
    """Edges between nodes that meet in a list."""

    def run(batches):
        for batch in slices(batches):
            parts = []
            for row in batch.column(0):
                around = row.values
                parts.append(
                    _best_in(around.field("other").to_numpy(), _matrix(around.field("unit")), most)
                )
            yield _edges(parts)

    return lists.select("around").mapInArrow(run, "node long, other long, near float")


def build_graph(nodes: DataFrame, count: int, degree: int = DEGREE) -> DataFrame:
    """``node, other``: the neighbour graph of all ``count`` nodes by NN-descent, which goes on
    until hardly an edge changes."""
    old = F.lit(True).alias("old")
    edges = written(_best(_first_edges(nodes, count).withColumn("old", F.lit(False)), degree), "graph")
    number = 0
    while True:
        met = _meet(_with_units(_around(edges, degree, number), nodes), _PROPOSED)
        known = edges.select(*_EDGE, old).union(met.withColumn("old", F.lit(False)))
        after = written(_best(known, degree), "graph")
        drop_tables(edges.sparkSession, edges)
        edges, number = after, number + 1
        fresh, every = edges.agg(F.count_if(~F.col("old")), F.count(F.lit(1))).first()
        if fresh <= _CHANGED * every:
            return edges.drop("old")


def _similarity():
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            near = np.einsum("ij,ij->i", _matrix(a), _matrix(b)) if len(a) else np.zeros(0)
            yield pa.array(near, pa.float32())

    return F.arrow_udf(run, "float")


def _cosine():
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            out = []
            for x, y in zip(a, b):
                x, y = np.asarray(x.as_py(), np.float64), np.asarray(y.as_py(), np.float64)
                # scaled so that no square leaves the range of doubles
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                out.append(float(x @ y) / (float(np.sqrt(x @ x)) * float(np.sqrt(y @ y))))
            yield pa.array(out, pa.float64())

    return F.arrow_udf(run, "double")


def _walk(starts: DataFrame, graph: DataFrame, units: DataFrame, beam: int) -> DataFrame:
    """``query, node, near``: the best nodes each query meets. ``starts`` has ``query, node, near``.

    A query walks until it has looked at all of its best nodes. A node that was dropped is
    never among the best again, so the walk ends.
    """
    wide = -(-beam // _WIDE)
    similarity = _similarity()
    best = W.partitionBy("query").orderBy(F.desc("near"), "node")
    state = begun = starts.withColumn("open", F.lit(True))
    while not state.where("open").isEmpty():
        of_open = W.partitionBy("query", "open").orderBy(F.desc("near"), "node")
        chosen = state.withColumn("chosen", F.col("open") & (F.row_number().over(of_open) <= wide))
        chosen = written(chosen, "beam")
        looked = chosen.where("chosen").join(graph, "node").select("query", F.explode("around").alias("a"))
        seen = (
            looked.select("query", F.col("a.other").alias("node"), F.col("a.unit").alias("unit"))
            .groupBy("query", "node").agg(F.first("unit").alias("unit"))
            .join(units, "query")
            .select("query", "node", similarity("unit", "query_unit").alias("near"), F.lit(True).alias("open"))
        )
        known = chosen.select("query", "node", "near", (F.col("open") & ~F.col("chosen")).alias("open"))
        merged = known.union(seen).groupBy("query", "node").agg(
            F.max("near").alias("near"), F.min("open").alias("open")
        )
        before = state
        state = written(
            merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= beam).drop("rank"), "beam"
        )
        drop_tables(state.sparkSession, chosen, None if before is begun else before)
    return state.select("query", "node", "near")


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    degree: int = DEGREE,
    beam: int | None = None,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest other rows by cosine.

    ``queries`` is a condition on the column ``vec_id`` that chooses rows as queries; all
    rows are indexed. Scores are cosines of the original vectors in double precision;
    nearest first, ties to the smaller id. Vectors that are null, zero or hold null or
    non-finite components take no part, nor rows with a null id or a length other than
    the most common one. Rows that repeat count once; of different vectors with one id the
    smallest counts. With fewer than ``k`` others all that were found are returned. Other
    columns are not read; an empty table gives an empty one.
    """
    ship(vectors.sparkSession)
    rows = written(_rows(vectors, id_col, vector_col), "vectors")
    nodes = _nodes(rows, k + 1)
    count = nodes.count()
    edges = build_graph(nodes, count, degree)
    graph = written(_with_units(_around(edges, degree, -1), nodes), "walkable")
    asked = rows.where(queries).join(nodes.select("vector", "node", "unit"), "vector")
    asked = written(asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")), "asked")
    # equal queries walk once
    of_query = nodes.join(asked.select(F.col("query").alias("node")).distinct(), "node", "left_semi")
    units = written(of_query.select(F.col("node").alias("query"), F.col("unit").alias("query_unit")), "asked")
    starts = units.select("query", F.col("query").alias("node"), F.lit(1.0).cast("float").alias("near"))
    found = _walk(starts, graph, units, max(beam or beam_for(count), 3 * k))
    scored = (
        found.join(nodes.select("node", "vector", "ids"), "node")
        .join(of_query.select(F.col("node").alias("query"), F.col("vector").alias("query_vector")), "query")
        .select("query", _cosine()("vector", "query_vector").alias("score"), F.explode("ids").alias("vec_id"))
    )
    order = [F.desc("score"), "vec_id"]
    few = scored.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order)))
    few = few.where(F.col("rank") <= k + 1).drop("rank")
    answers = asked.join(few, "query").where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    ranked = answers.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
