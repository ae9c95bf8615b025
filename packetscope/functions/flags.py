"""TCP control bits: mask to names, names to mask, and bit tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetscope.constants import SUSPICIOUS_FLAG_TEXT, TCP_BITS
from packetscope.functions.text import any_of, flag

BIT = dict(TCP_BITS)


def has_bit(mask: Column, name: str) -> Column:
    return mask.bitwiseAND(F.lit(BIT[name])) != 0


def has_all(mask: Column, *names: str) -> Column:
    want = sum(BIT[n] for n in names)
    return mask.bitwiseAND(F.lit(want)) == want


def flag_names(mask: Column, separator: str = " ", bits: int = 8) -> Column:
    """Names of the set bits, lowest first; ``None`` for no bit, NULL for no mask."""
    picked = [F.when(has_bit(mask, n), F.lit(n)) for n, _ in TCP_BITS[:bits]]
    used = sum(b for _, b in TCP_BITS[:bits])
    return (
        F.when(mask.isNull(), F.lit(None).cast("string"))
        .when(mask.bitwiseAND(F.lit(used)) == 0, F.lit("None"))
        .otherwise(F.concat_ws(separator, *picked))
    )


def flag_mask(names: Column) -> Column:
    """Mask of a space- or plus-separated list of names; unknown names add nothing."""
    parts = F.split(F.upper(names), r"[ +,]+")
    bits = [F.when(F.array_contains(parts, n), F.lit(b)).otherwise(F.lit(0)) for n, b in TCP_BITS]
    return F.when(names.isNotNull(), reduce(lambda a, b: a + b, bits))


def suspicious(mask: Column) -> Column:
    """RST with ACK, FIN with RST, or SYN with FIN."""
    return flag(
        has_all(mask, "RST", "ACK") | has_all(mask, "FIN", "RST") | has_all(mask, "SYN", "FIN")
    )


def suspicious_literal(names: Column) -> Column:
    """The same three pairs looked up as plain text in the joined names."""
    return flag(any_of([names.contains(t) for t in SUSPICIOUS_FLAG_TEXT]))
