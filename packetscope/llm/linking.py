"""From band collisions to classes, without ever listing the pairs of a bucket.

``repeated`` finds which hashes occur with more than one value, as a bitmap of bounded
size. ``classes`` verifies colliding items and joins them. In each round every bucket
names a few hubs, and a hub is compared with the bucket's other items that are not in its
class yet. A hub that met its whole bucket is done there. Rounds go on until the items left
in every bucket are in one class, so no colliding pair of different classes is left
unchecked, whatever the bucket's size.

The first rounds find nearly all links: pairs are joined with the contents, a few per item
and round. In later rounds, while the hubs are few bytes, they go to the items as a
broadcast, an item meets all its hubs in one look, and no pair is made a row; beyond that
they are joined as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetscope.llm.common import giving_back
from packetscope.llm.comparing import Hubs, links_within, prefix_of, roots_of, similar
from packetscope.session import release, remove, written

# bits of the bitmap of repeated hashes: the least, and the most whatever the input's size
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
# rounds that always join pairs with contents; and the bytes of hubs that are broadcast in
# later rounds, which have few buckets left
JOINED_ROUNDS, BROADCAST_BYTES = 2, 16 << 20
# links that one worker joins
ONE_WORKER_LINKS = 200_000
# links whose ends' least neighbours are broadcast while classes are made; about 50 bytes each
BROADCAST_LINKS = 200_000
# hubs of a bucket by round: the first finds most links, the later ones what it missed
_HUBS = (1, 4, 16)
# the same where hubs are broadcast, which makes no rows of pairs
_SHARED_HUBS = 256
# items of a bucket that one worker compares, and items it gets at one time, about
WITHIN, _ITEMS = 1 << 14, 1 << 14
_CELL = 32768  # bits in one piece of Spark's bitmap functions
# bits of the bitmap that come to the driver at one time
_BITS_AT_ONCE = 1 << 26


def _second(values):
    """Another place for the same hash: its upper half."""
    return values >> 32


class Repeated:
    """A set of hashes as a bitmap with two bits each. It may say yes to others, never no to
    its own."""

    def __init__(self, bits: int, cells: dict[int, bytes]):
        self.mask = bits - 1
        self.bytes = np.zeros(bits // 8, np.uint8)
        for cell, content in cells.items():
            self.bytes[cell * _CELL // 8 : (cell + 1) * _CELL // 8] = np.frombuffer(content, np.uint8)

    def has(self, values: np.ndarray) -> np.ndarray:
        found = np.ones(values.shape, bool)
        for at in (values & self.mask, _second(values) & self.mask):
            found &= (self.bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def repeated(hashes: DataFrame) -> Repeated:
    """Which ``h`` occur with at least two different ``v``.

    Counted over all rows. The bitmap grows with the number found, 64 bits and more for
    each, up to a fixed bound; beyond it more hashes pass that only look repeated, which
    costs time and changes no result.
    """
    found = written(
        hashes.groupBy("h").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a <> b").select("h"),
        "repeated",
    )
    return _bitmap(found, found.count())


# rows of hashes in blocks: a part holds all occurrences of its hashes
BLOCKS = "part int, h binary, v binary"
# hashes of a task that are dealt to parts at one time, parts for each partition of a table, and at most
_DEALT, _PARTS, _MOST_PARTS = 1 << 18, 4, 1 << 15


def parts_for(table: DataFrame) -> int:
    """How many parts the hashes of a table are dealt to, so that one fits a worker."""
    return min(_MOST_PARTS, _PARTS * max(1, table.rdd.getNumPartitions()))


def by_part(hashes: np.ndarray, parts: int):
    """Each part that has some of these hashes, and their places in the order given."""
    part = (hashes.view(np.uint64) % np.uint64(parts)).astype(np.uint16)
    order = np.argsort(part, kind="stable")
    found, first = np.unique(part[order], return_index=True)
    return found.tolist(), np.split(order, first[1:])


def dealt(pairs: Iterator[tuple[np.ndarray, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """Arrays ``h, v`` as rows of ``BLOCKS``."""

    def block(held):
        h, v = (np.concatenate(arrays) for arrays in zip(*held))
        found, places = by_part(h, parts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(found, pa.int32()),
                *(pa.array([values[at].tobytes() for at in places], pa.binary()) for values in (h, v)),
            ],
            names=["part", "h", "v"],
        )

    held, size = [], 0
    for pair in pairs:
        if len(pair[0]):
            held.append(pair)
            size += len(pair[0])
        if size >= _DEALT:
            yield block(held)
            held, size = [], 0
    if held:
        yield block(held)


def _again(rows: pa.Table) -> pa.Table:
    """``h, n`` of a part: the hashes with at least two different ``v``, and how often they occur."""
    h, v = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.int64) for c in ("h", "v"))
    order = np.argsort(h)
    h, v = h[order], v[order]
    found = np.unique(h[1:][(h[1:] == h[:-1]) & (v[1:] != v[:-1])])
    number = np.searchsorted(h, found, "right") - np.searchsorted(h, found)
    return pa.table({"h": pa.array(found, pa.int64()), "n": pa.array(number, pa.int64())})


def repeated_blocks(blocks: DataFrame) -> tuple[Repeated, int]:
    """``repeated`` for rows of ``BLOCKS``, and how often the repeated hashes occur in all."""
    found = written(blocks.groupBy("part").applyInArrow(_again, "h long, n long"), "repeated")
    number, occurrences = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return _bitmap(found.select("h"), number), occurrences


def _bitmap(found: DataFrame, number: int) -> Repeated:
    """The hashes of a scratch table, which is deleted."""
    spark = found.sparkSession
    bits = LEAST_BITS
    while bits < min(64 * number, MOST_BITS):
        bits *= 2
    places = F.array(F.col("h"), F.shiftright("h", 32))
    cells = written(
        found.select(F.explode(places).alias("h"))
        .select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("p"))
        .groupBy(F.expr(f"p div {_CELL}").alias("cell"))
        .agg(F.bitmap_construct_agg(F.col("p") % _CELL).alias("bitmap")),
        "cells",
    )
    # a job for some MB of the bitmap, not for each partition of the shuffle
    few = cells.coalesce(-(-bits // _BITS_AT_ONCE))
    out = Repeated(bits, {r["cell"]: bytes(r["bitmap"]) for r in few.toLocalIterator()})
    drop_tables(spark, found, cells)
    release(spark)
    return out


def drop_tables(spark: SparkSession, *tables: DataFrame | None) -> None:
    """Delete scratch tables by the files they read."""
    for df in tables:
        if df is not None:
            for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
                remove(spark, folder)


def connected(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links (a, b)``; the root is the smallest node.

    A few links are joined by one worker. More alternate between joining every node's larger
    neighbours to its smallest and joining its smaller neighbours to each other, until nothing
    changes. A node with many links is combined in the tasks before it is shuffled.
    """
    spark = links.sparkSession
    ordered = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, mark = _marked(ordered.where("u <> v").distinct())
    while True:
        if mark[0] <= ONE_WORKER_LINKS:
            after = written(_stars(edges), "edges")
            drop_tables(spark, edges)
            edges = after
            break
        few = F.broadcast if mark[0] <= BROADCAST_LINKS else (lambda df: df)
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = (
            edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
            .join(few(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).where("u <> v")
        larger = larger.distinct()
        smallest = larger.groupBy("u").agg(F.min("v").alias("m"))
        down = larger.join(few(smallest), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = mark
        after, mark = _marked(down.where("u <> v").union(smallest.select("u", F.col("m").alias("v"))).distinct())
        drop_tables(spark, edges)
        edges = after
        if mark == before:
            break
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(edges: DataFrame) -> DataFrame:
    """The edges ``u, v`` from every node to its root, found in one task."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches):
        held = list(batches)
        if held:
            links = pa.Table.from_batches(held)
            u, v = joined(links.column("u").combine_chunks(), links.column("v").combine_chunks())
            yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"])

    return edges.coalesce(1).mapInArrow(giving_back(run), f"u {kind}, v {kind}")


def joined(a: pa.Array, b: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Nodes of the links ``a, b`` with their roots, without the roots themselves."""
    coded = pa.concat_arrays([a, b]).dictionary_encode()
    # nodes by their order, so that the root is the least
    sort = pc.sort_indices(coded.dictionary)
    rank = np.argsort(np.asarray(sort))[np.asarray(coded.indices)]
    root = roots_of(rank[: len(a)], rank[len(a) :], len(sort))
    node = np.flatnonzero(root != np.arange(len(root)))
    names = coded.dictionary.take(sort)
    return names.take(pa.array(node)), names.take(pa.array(root[node]))


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, their number and two hashes of them all.

    Not by an ``Observation``: a session that has made one cannot be sent with Spark's forests.
    """
    table = written(edges, "edges")
    hashes = (F.bit_xor(F.xxhash64(*order)) for order in ("uv", "vu"))
    return table, tuple(table.agg(F.count(F.lit(1)), *hashes).first())


def _met(items: DataFrame, hubs: Hubs, least: float, key: str) -> DataFrame:
    """``a, b``: classes of items and of the hubs that are like them."""
    shared = items.sparkSession.sparkContext.broadcast(hubs)

    def run(batches):
        meet = shared.value
        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("root", "buckets", "values", "weights"))
            links = set()
            for root, buckets, values, weights in zip(*columns):
                links.update((root, other) for other in meet(root, buckets, values, weights, least))
            yield pa.RecordBatch.from_arrays(
                [pa.array([link[side] for link in links], pa.binary()) for side in (0, 1)], names=["a", "b"]
            )

    return items.mapInArrow(giving_back(run), f"a {key}, b {key}")


def _paired(now: DataFrame, hubs: DataFrame, content: DataFrame, least: float) -> DataFrame:
    """``a, b`` like ``_met``, for hubs of any number: pairs are joined with the contents.

    Items learn where they lie which hubs they meet, and travel once for each. Of two items
    that are each other's hub one travels.
    """
    pairs = written(
        now.join(hubs, "bucket")
        .where("root <> hub_root")
        .groupBy(F.least("key", "hub").alias("low"), F.greatest("key", "hub").alias("high"))
        .agg(F.min(F.struct("key", "hub", "root", "hub_root")).alias("pair"))
        .select("pair.*"),
        "pairs",
    )
    # both joins read one exchange of the contents
    items = content.join(pairs, "key").select("hub", "root", "hub_root", F.col("body").alias("item"))
    bodies = content.join(pairs.select(F.col("hub").alias("key")).distinct(), "key", "left_semi")
    both = items.join(bodies.select(F.col("key").alias("hub"), "body"), "hub")
    linked = both.where(similar(least)("item", "body"))
    linked = linked.select(F.least("root", "hub_root").alias("a"), F.greatest("root", "hub_root").alias("b"))
    linked = written(linked.distinct(), "links")
    drop_tables(linked.sparkSession, pairs)
    return linked


def classes(members: DataFrame, content: DataFrame, least: float) -> DataFrame:
    """``key, root`` for the items that are linked to another one.

    ``members`` has ``bucket, key``; ``content`` has ``key, body``, for one item as often
    as it likes but always the same. A body has ``values`` and ``weights`` (see
    ``comparing``); items of a bucket are linked at a similarity of ``least`` or more.
    """
    spark = members.sparkSession
    kind = members.schema["key"].dataType.simpleString()
    crowds = members.groupBy("bucket").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b")
    members = written(members.join(crowds.select("bucket"), "bucket", "left_semi").distinct(), "members")
    wanted = content.join(members.select("key").distinct(), "key", "left_semi")
    content = written(wanted.groupBy("key").agg(F.first("body").alias("body")), "content")
    labels = None
    number = 0
    shared = False
    while True:
        if labels is None:
            now = members.withColumn("root", F.col("key"))
        else:
            now = members.join(labels, "key", "left").withColumn("root", F.coalesce("root", "key"))
        # hubs are items of small classes, which meet the most others
        # (at most 256 of a bucket, so a list of them is short)
        fewest = _HUBS[min(number, 2)]
        most = _SHARED_HUBS if shared or number == JOINED_ROUNDS else fewest
        salt = F.pmod(F.xxhash64("root", F.lit(number)), F.lit(most))
        order = F.xxhash64("key", F.lit(number))
        roots = now.groupBy("bucket", "root").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct(order.alias("o"), "key")).alias("k")
        )
        hubs = (
            roots.groupBy("bucket", salt.alias("salt"))
            .agg(
                F.min(F.struct("n", F.col("k.o").alias("o"), F.col("k.key").alias("key"), "root")).alias("hub"),
                F.min("root").alias("low"), F.max("root").alias("high"),
            )
            .groupBy("bucket")
            .agg(F.sort_array(F.collect_list("hub")).alias("hubs"), F.min("low").alias("low"), F.max("high").alias("high"))
            .where("low <> high")
            .select("bucket", F.posexplode("hubs").alias("place", "hub"))
            .select("bucket", "place", F.col("hub.key").alias("hub"), F.col("hub.root").alias("hub_root"))
        )
        hubs = written(hubs, "hubs")
        if hubs.isEmpty():
            drop_tables(spark, hubs)
            break
        chosen = hubs.select(F.col("hub").alias("key")).distinct()
        shared = number >= JOINED_ROUNDS
        if shared:
            bodies = content.join(chosen, "key", "left_semi")
            weight = F.octet_length("body.values") + F.coalesce(F.octet_length("body.weights"), F.lit(0))
            shared = (bodies.agg(F.sum(weight + 512)).first()[0] or 0) <= BROADCAST_BYTES
        now = now.join(hubs.select("bucket"), "bucket", "left_semi")
        if shared:  # a hub meets the items of all its buckets, so a pair meets once in all rounds
            items = written(
                now.groupBy("key")
                .agg(F.first("root").alias("root"), F.collect_list("bucket").alias("buckets"))
                .join(content, "key")
                .select("key", "root", "buckets", "body.values", "body.weights"),
                "items",
            )
            meet = Hubs(items.join(chosen, "key", "left_semi").toArrow())
            linked = written(_met(items, meet, least, kind).distinct(), "links")
            done = members.join(chosen, "key", "left_anti")
            drop_tables(spark, items)
        else:
            hubs = hubs.where(F.col("place") < fewest)
            linked = _paired(now, hubs, content, least)
            done = members.join(
                hubs.select("bucket", F.col("hub").alias("key")), ["bucket", "key"], "left_anti"
            )
        # only buckets with several classes go on, without the hubs that met all of theirs
        rest = written(done.join(hubs.select("bucket"), "bucket", "left_semi"), "members")
        if not linked.isEmpty():
            joined = connected(linked)
            fresh = joined.where("node <> root").select(F.col("node").alias("key"), "root")
            if labels is not None:
                moved = labels.join(joined.withColumnRenamed("root", "new"), F.col("root") == F.col("node"), "left")
                fresh = moved.select("key", F.coalesce("new", "root").alias("root")).union(fresh)
            labels = written(fresh, "labels")
        drop_tables(spark, linked, hubs, members)
        members = rest
        number += 1
    if labels is None:
        labels = spark.createDataFrame([], f"key {kind}, root {kind}")
    drop_tables(spark, members, content)
    release(spark)
    # the root itself belongs to its class
    return labels.union(labels.select(F.col("root").alias("key"), "root").distinct())


def _sizes(members: DataFrame) -> DataFrame:
    """``bucket, n`` of buckets with several items."""
    return members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _sum_and_most(sizes: DataFrame) -> tuple[int, int]:
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()


def _apart(members: DataFrame, least: float) -> DataFrame:
    """``bucket, key``: buckets cut by the values that several of their items have in the prefix.

    ``members`` has ``bucket, key, values``. Rare values come first, so unlike items with a
    common passage hardly meet, but similar ones do (see ``comparing.links_within``).
    """
    share = round(least * 1000)

    def listed(batches):
        for batch in batches:
            sets = batch.column("values")
            size = np.asarray(pc.binary_length(sets)).astype(np.int64) // 8
            of = pa.array(np.repeat(np.arange(len(size)), size))
            values = np.frombuffer(b"".join(sets.to_pylist()), np.int64)
            prefix = np.repeat(prefix_of(size, share), size).astype(np.int32)
            columns = [batch.column(name).take(of) for name in ("bucket", "key")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(prefix), pa.array(values)], names=["bucket", "key", "prefix", "value"]
            )

    kind = members.schema["key"].dataType.simpleString()
    every = members.select("bucket", "key", "values").mapInArrow(
        giving_back(listed), f"bucket long, key {kind}, prefix int, value long"
    )
    times = every.groupBy("bucket", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    order = Window.partitionBy("bucket", "key").orderBy("times", "value")
    first = (
        every.join(times, ["bucket", "value"], "left")
        .withColumn("times", F.coalesce("n", F.lit(1)))
        .withColumn("place", F.row_number().over(order))
        .where("place <= prefix AND n IS NOT NULL")
    )
    return first.select(F.xxhash64("bucket", "value").alias("bucket"), "key")


def classes_of_sets(items: DataFrame, least: float) -> DataFrame:
    """``key, root`` as from ``classes``, for plain sets whose buckets are mostly small.

    ``items`` has ``key, buckets, values``, a key as often as it likes but always the same. The
    items of a bucket of at most ``WITHIN`` meet in one worker. Larger ones are cut by the values
    of their items' prefixes (``_apart``); what is large even then goes through the rounds
    of ``classes``. A worker joins what it linked, so that chains do not lengthen ``connected``.
    """
    spark = items.sparkSession
    kind = items.schema["key"].dataType.simpleString()
    one = items.groupBy("key").agg(F.first(F.struct("buckets", "values")).alias("body"))
    content = written(one.select("key", "body.buckets", "body.values"), "content")
    sizes = _sizes(content.select(F.explode("buckets").alias("bucket")))
    number, most = _sum_and_most(sizes)
    members = small = content.select("key", "values", F.explode("buckets").alias("bucket"))
    large = apart = crowd = None
    if most > WITHIN:
        large = written(sizes.where(F.col("n") > WITHIN).select("bucket"), "large")
        apart = written(_apart(members.join(large, "bucket", "left_semi"), least), "apart")
        sizes = _sizes(apart)
        more, most = _sum_and_most(sizes)
        number += more
        crowd = written(sizes.where(F.col("n") > WITHIN).select("bucket"), "crowd")
        several = sizes.where(F.col("n") <= WITHIN).select("bucket")
        less = apart.join(several, "bucket", "left_semi").join(content.select("key", "values"), "key")
        small = members.join(large, "bucket", "left_anti").unionByName(less)

    def linked(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")
        several = np.append(False, bucket[order][1:] == bucket[order][:-1])
        order = order[several | np.append(several[1:], False)] if len(order) else order
        rows = rows.take(pa.array(order))
        sets = rows.column("values").to_pylist()
        of = np.fromiter(map(len, sets), np.int64, len(sets)) // 8
        pairs = links_within(bucket[order], of, np.frombuffer(b"".join(sets), np.uint64), least)
        keys = rows.column("key").combine_chunks()
        node, root = joined(*(keys.take(pa.array(side)) for side in pairs))
        return pa.table({"a": node, "b": root})

    part = F.pmod("bucket", F.lit(1 + number // _ITEMS)).alias("part")
    links = small.select(part, "bucket", "key", "values").groupBy("part").applyInArrow(linked, f"a {kind}, b {kind}")
    links = written(links, "links")
    every, rounds = links, None
    if most > WITHIN:
        met = apart.join(crowd, "bucket", "left_semi")
        body = F.struct("values", F.lit(None).cast("binary").alias("weights")).alias("body")
        rounds = written(classes(met, content.select("key", body), least), "rounds")
        every = links.union(rounds)
    if every.isEmpty():
        out = spark.createDataFrame([], f"key {kind}, root {kind}")
    else:
        out = connected(every).withColumnRenamed("node", "key")
    drop_tables(spark, links, rounds, large, apart, crowd, content)
    release(spark)
    return out
