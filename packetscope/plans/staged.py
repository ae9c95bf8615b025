"""Columns that are worked out once per row and then used many times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns the optimizer will not copy into the expressions that use them.

    Plain projections are merged and predicates are pushed through them, which
    repeats a costly expression at every use. A one-element ``inline`` keeps the
    row count, stays in generated code, and its output is only ever read.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
