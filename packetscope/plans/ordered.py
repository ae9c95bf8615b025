"""Row numbers and running totals over a whole table, without one big task.

A window with no partition key would sort everything in a single task. Here the
rows are range-partitioned by the sort key, written once, and each range gets an
offset from the (few) range totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetscope.session import shared_dir

_POS = "__pos"
_RANGE = "__range"
# monotonically_increasing_id keeps the partition above this bit and the row below
_ROW_BITS = 33


def _in_ranges(df: DataFrame, order: list[Column] | None) -> DataFrame:
    """Sorted copy with the range number and the place inside the range.

    Without an order the rows stay as they are read, partition by partition.

    The copy is checkpointed: both later passes must see the same ranges, also
    after an executor is lost.
    """
    shared_dir(df.sparkSession)
    rows = df if order is None else df.orderBy(*order)
    placed = rows.withColumn(_POS, F.monotonically_increasing_id())
    return placed.withColumn(_RANGE, F.shiftright(_POS, _ROW_BITS)).checkpoint()


def _with_offsets(ranges: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Add, per row, the sums of ``totals`` over all earlier ranges.

    The totals table has one row per partition of the copy, so its size is bounded
    by the partition count and it is safe to window in one task and broadcast.
    """
    per_range = ranges.groupBy(_RANGE).agg(*[c.alias(n) for n, c in totals.items()])
    before = W.orderBy(_RANGE).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_range.select(
        _RANGE, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in totals]
    )
    return ranges.join(F.broadcast(offsets), _RANGE)


def number_rows(
    df: DataFrame, order: list[Column] | None, name: str = "packet_no"
) -> DataFrame:
    """Add 1..n in the given total order, or in the order the rows are read in."""
    ranges = _in_ranges(df, order)
    local = F.col(_POS).bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    numbered = _with_offsets(ranges, {"__before": F.count(F.lit(1))})
    return numbered.withColumn(name, F.col("__before") + local).drop(_POS, _RANGE, "__before")


def running_totals(df: DataFrame, order: list[Column], columns: dict[str, str]) -> DataFrame:
    """Add running sums in the given total order; ``columns`` maps source to new name."""
    ranges = _in_ranges(df, order)
    joined = _with_offsets(ranges, {f"__b_{new}": F.sum(c) for c, new in columns.items()})
    upto = W.partitionBy(_RANGE).orderBy(_POS).rowsBetween(W.unboundedPreceding, 0)
    sums = {new: F.col(f"__b_{new}") + F.sum(c).over(upto) for c, new in columns.items()}
    return joined.withColumns(sums).drop(_POS, _RANGE, *[f"__b_{n}" for n in columns.values()])
