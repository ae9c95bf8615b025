"""Exact stratified split by hash rank, with no shuffle of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetscope.session import written

# hex digits a round adds: 65,536 even buckets per class, so the counts stay a small table
_DIGITS, _ALL_DIGITS = 4, 32
# rows of a class in the bucket of the cut that are few enough to be ranked
FEW = 100_000


def _cut_buckets(rows: DataFrame, label: str, digits: int, ranks: dict | None, tenths: int) -> dict:
    """class -> (bucket of the cut, rank of the cut in it, rows in it).

    ``ranks`` says which row of a class the cut is; without it, it is the class's share.
    """
    counts = rows.groupBy(label, F.substring("__hash", 1, digits).alias("bucket")).agg(F.count("*").alias("n"))
    in_class = W.partitionBy(label)
    upto = F.sum("n").over(in_class.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    keep = F.floor(F.sum("n").over(in_class) * tenths / 10) if ranks is None else _of_class(label, ranks, "bigint")
    placed = counts.select(label, "bucket", "n", upto.alias("upto"), keep.alias("keep"))
    cut = placed.filter((F.col("upto") >= F.col("keep")) & (F.col("upto") - F.col("n") < F.col("keep")))
    return {r[label]: (r.bucket, r.keep - r.upto + r.n, r.n) for r in cut.collect()}


def _of_class(label: str, values: dict, kind: str) -> Column:
    """The value of a row's class; NULL for other classes."""
    out = F.lit(None).cast(kind)
    for known, value in values.items():
        out = F.when(F.col(label) == known, F.lit(value).cast(kind)).otherwise(out)
    return out


def split_thresholds(hashed: DataFrame, key: str, label: str, tenths: int, few: int = FEW) -> dict:
    """class -> (hash, key) of the last row that belongs to the first part.

    Counts per hash prefix find the bucket where the cut falls; its prefix grows digit by
    digit until the bucket is small, and only that bucket is ranked. A class whose first
    part is empty is left out. One row per class comes to the driver.
    """
    narrow = hashed.select(label, key, "__hash").filter(F.col(label).isNotNull())
    rows, ranks, digits, cut = narrow, None, 0, {}
    while digits < _ALL_DIGITS:
        digits += _DIGITS
        cut = _cut_buckets(rows, label, digits, ranks, tenths)
        bucket = _of_class(label, {c: b for c, (b, _, _) in cut.items()}, "string")
        rows = narrow.filter(F.substring("__hash", 1, digits) == bucket)
        ranks = {c: rank for c, (_, rank, _) in cut.items()}
        if all(n <= few for _, _, n in cut.values()):
            break
    # a key that repeats is one row here, however often it does
    edge = rows.groupBy(label, "__hash", key).agg(F.count("*").alias("n"))
    order = W.partitionBy(label).orderBy("__hash", key)
    upto = edge.withColumn("upto", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)))
    rank = _of_class(label, ranks, "bigint")
    last = upto.filter((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank))
    return {r[label]: (r["__hash"], r[key]) for r in last.collect()}


def stratified_split(
    df: DataFrame, key: str, label: str, tenths: int = 7, seed: int = 42, few: int = FEW
) -> DataFrame:
    """Add ``is_train``: per class, the first ``tenths``/10 rows in hash order are 1.

    The rows are worked out once and written; thresholds read three narrow columns of
    that table, and the result is the table with a comparison. Rows with equal keys stay
    together, rows without a class are 0. Classes are few, two for threat labels.
    """
    hashed = df.withColumn("__hash", F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))))
    hashed = written(hashed, "split")
    limits = split_thresholds(hashed, key, label, tenths, few)
    last = _of_class(label, {c: h for c, (h, _) in limits.items()}, "string")
    last_key = _of_class(label, {c: k for c, (_, k) in limits.items()}, dict(df.dtypes)[key])
    inside = (F.col("__hash") < last) | ((F.col("__hash") == last) & (F.col(key) <= last_key))
    return hashed.withColumn("is_train", F.coalesce(inside, F.lit(False)).cast("int")).drop("__hash")
