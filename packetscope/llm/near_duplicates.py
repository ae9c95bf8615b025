"""Near-duplicate documents by ProbMinHash over weighted word shingles.

Each shingle of a text is a Poisson process whose rate is the shingle's weight; every
arrival falls into one component of the signature, which keeps the shingle of its first
arrival. A shingle stops as soon as its next arrival is later than every component's
first. Two signatures agree in a component with the probability Jaccard similarity of the
weights. Bands of components propose pairs, exact similarities decide, and links become
classes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetscope.llm.common import byte_slices, giving_back, id_and_text, id_type, slices, text_udf, words_of
from packetscope.llm.linking import classes, repeated
from packetscope.llm.shingles import Shingler, bands_of, counted, mixed, tuned
from packetscope.session import ship, written

SIMILARITY = 0.8
# arrivals of one shingle that are drawn at a time, once few shingles are left
_AT_ONCE = 16
# components of a signature at most
_COMPONENTS = 64
# texts hashed together, and their bytes: hashing takes some thirty times the memory of a text
_TEXTS, _BYTES = 1024, 1 << 21


def weights_of(counts: np.ndarray) -> np.ndarray:
    """A shingle that repeats weighs more, but not as often as it repeats."""
    return 1 + np.log(counts)


def prob_minhash(
    values: np.ndarray, weights: np.ndarray, texts: np.ndarray, n_texts: int, size: int
) -> np.ndarray:
    """A row of ``size`` components per text."""
    first = np.full((n_texts, size), np.inf)
    owner = np.zeros((n_texts, size), np.uint64)
    clock = np.zeros(len(values))
    live = np.arange(len(values))
    number = 0
    while len(live):
        at_once = 1 if number < 2 else _AT_ONCE
        steps = np.arange(number + 1, number + at_once + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        draw = mixed(values[live][:, None] + steps)
        # 52 bits for the waiting time, the rest of another draw for the component
        wait = -np.log(((draw >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52)
        time = clock[live][:, None] + np.cumsum(wait / weights[live][:, None], axis=1)
        part = (mixed(draw) >> np.uint64(16)) % np.uint64(size)
        last = first.max(axis=1)
        clock[live] = time[:, -1]
        early = time < last[texts[live]][:, None]
        row, column = np.nonzero(early)
        if len(row):
            place = texts[live][row] * size + part[row, column].astype(np.int64)
            arrived = time[row, column]
            np.minimum.at(first.reshape(-1), place, arrived)
            won = first.reshape(-1)[place] == arrived
            owner.reshape(-1)[place[won]] = values[live][row[won]]
        last = first.max(axis=1)
        live = live[clock[live] < last[texts[live]]]
        number += at_once
    return owner


class Signer:
    """Keys, bands and shingles of texts, on a worker."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.shingle = bands, rows, Shingler()

    def key(self, words: list[bytes]) -> bytes:
        """Equal for texts of equal words, whatever stands between them."""
        return hashlib.md5(b" ".join(words)).digest()

    def __call__(self, texts: list[str]):
        """For all texts: key or None, a row of bands, distinct shingles and weights."""
        words = [words_of(t) for t in texts]
        values, owners, counts = counted(*self.shingle(words))
        weights = weights_of(counts)
        signature = prob_minhash(values, weights, owners, len(texts), self.bands * self.rows)
        ends = np.searchsorted(owners, np.arange(len(texts) + 1))
        keys = [self.key(w) if w else None for w in words]
        return keys, bands_of(signature, self.rows), values, weights, ends


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _hashes(texts: DataFrame, bands: int, rows: int) -> DataFrame:
    """``h, v``: every band with its text's key."""

    def run(batches):
        sign = Signer(bands, rows)
        for batch in byte_slices(slices(batches, _TEXTS), 1, _BYTES):
            keys, found, *_ = sign(batch.column(1).to_pylist())
            has = np.asarray([k is not None for k in keys], bool)
            short = np.asarray([_short(k) for k in keys if k is not None], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[has].ravel()), pa.array(np.repeat(short, bands))], names=["h", "v"]
            )

    return texts.mapInArrow(giving_back(run), "h long, v long")


def _signed(texts: DataFrame, bands: int, rows: int, shared) -> DataFrame:
    """``doc_id, key`` of all rows; bands that repeat, and for those the shingles."""

    def run(batches):
        sign, again = Signer(bands, rows), shared.value
        for batch in byte_slices(slices(batches, _TEXTS), 1, _BYTES):
            keys, found, values, weights, ends = sign(batch.column(1).to_pylist())
            hit = again.has(found.ravel()).reshape(found.shape)
            out_bands, out_values, out_weights = [], [], []
            for i, key in enumerate(keys):
                near = key is not None and hit[i].any()
                out_bands.append(found[i][hit[i]].tolist() if near else None)
                part = slice(ends[i], ends[i + 1])
                out_values.append(values[part].tobytes() if near else None)
                plain = not near or (weights[part] == 1).all()
                out_weights.append(None if plain else weights[part].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(keys, pa.binary()),
                    pa.array(out_bands, pa.list_(pa.int64())),
                    pa.array(out_values, pa.binary()),
                    pa.array(out_weights, pa.binary()),
                ],
                names=["doc_id", "key", "bands", "values", "weights"],
            )

    kind = id_type(texts, "doc_id")
    return texts.mapInArrow(
        giving_back(run), f"doc_id {kind}, key binary, bands array<long>, values binary, weights binary"
    )


def keyed_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, key, root`` of every row: the key of its words and of its class's smallest text.

    Rows without words have neither.
    """
    spark = docs.sparkSession
    ship(spark)
    bands, rows = tuned(similarity, most=_COMPONENTS)
    again = repeated(_hashes(docs, bands, rows))
    table = written(_signed(docs, bands, rows, spark.sparkContext.broadcast(again)), "signed")
    near = table.where("values IS NOT NULL")
    content = near.select("key", F.struct("values", "weights").alias("body"))
    members = near.select("key", F.explode("bands").alias("bucket"))
    linked = classes(members, content, similarity)
    every = table.select("doc_id", "key")
    return every.join(linked, "key", "left").select(
        "doc_id", "key", F.coalesce("root", "key").alias("root")
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``doc_id, class_id, kept``, a row per row: classes of near-duplicate documents.

    Linked are texts with equal words and texts whose shingles of five words (weighing
    1 + ln of their count) have a probability Jaccard similarity of at least
    ``similarity``; classes are what links connect. The class id is the smallest id in the
    class, ``kept`` marks the rows with it. Words are lower-case runs of ASCII letters and
    digits and anything beyond ASCII. A text of one to four words is one shingle. Null
    and empty texts and those without words are classes of their own, with their own id.
    Rows that repeat whole are all kept rows of their class; null ids are never the
    smallest, a class of nothing else has a null id. Other columns are not read; an empty
    table gives an empty one.

    Copies are never expanded into pairs, and no bucket's pairs are listed (see
    ``linking``).
    """
    found = keyed_classes(id_and_text(docs, id_col, text_col), similarity)
    found = written(found, "classes")
    least = found.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    many = found.where("root IS NOT NULL").join(least, "root").select("doc_id", "class_id")
    alone = found.where("root IS NULL").select("doc_id", F.col("doc_id").alias("class_id"))
    return many.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def without_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """The rows of ``docs`` with one document of each class, all columns as they are.

    The document with the smallest id stays; of rows that agree in id and words, the one with
    the smallest text, then the smallest other columns from left to right, nulls first.
    Columns that have no order, such as maps, are not compared. Rows without words all stay.
    """
    texts = id_and_text(docs, id_col, text_col)
    found = written(keyed_classes(texts, similarity).where("key IS NOT NULL"), "classes")
    # the smallest id, then the smallest text: one text of one id wins
    best = found.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best")
    )
    losers = (
        found.join(best, "root")
        .where(~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key"))))
        .select("doc_id", "key")
        .distinct()
    )
    name = "key"
    while name in docs.columns:
        name += "_"

    def worker():
        sign = Signer(1, 1)
        return lambda some: [sign.key(w) if (w := words_of(t)) else None for t in some]

    keyed = docs.withColumn(name, text_udf("binary", pa.binary(), worker)(docs[text_col]))
    lost = losers.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
    match = keyed[id_col].eqNullSafe(lost["__id"]) & (keyed[name] == lost["__key"])
    stay = keyed.where(F.col(name).isNotNull()).join(lost, match, "left_anti")
    wordless = keyed.where(F.col(name).isNull())
    order = [text_col, *(c for c in docs.columns if c != text_col and _has_order(docs.schema[c].dataType))]
    if len(order) == len(docs.columns):
        least = F.min(F.struct(*order))
    else:
        least = F.min_by(F.struct(*docs.columns), F.struct(*order))
    single = stay.groupBy(docs[id_col].alias("__id"), F.col(name).alias("__key")).agg(least.alias("__row"))
    return single.select("__row.*").select(*docs.columns).union(wordless.drop(name))


def _has_order(kind: T.DataType) -> bool:
    """Whether values of a type can be compared."""
    if isinstance(kind, T.StructType):
        return all(_has_order(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_order(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))
