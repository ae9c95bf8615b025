"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetscope.functions.text import any_of, has_text

_USUAL = ["TCP", "UDP", "ICMP", "ARP"]


def protocol_matches(wanted: str, protocol: Column | None = None) -> Column:
    """``All`` passes everything, ``Other`` what is none of the usual four.

    The label is compared first, so a capture with a protocol called ``Other``
    still matches it. Case does not matter.
    """
    protocol = F.coalesce(F.col("protocol") if protocol is None else protocol, F.lit(""))
    if wanted == "All":
        return F.lit(True)
    if wanted == "Other":
        return ~F.upper(protocol).isin(_USUAL)
    return F.upper(protocol) == wanted.upper()


def either_contains(first: str, second: str, needle: str) -> Column:
    """Substring in one of two columns, numbers compared as text."""
    sides = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (first, second)]
    return any_of([s.contains(needle) for s in sides])


def filter_packets(df: DataFrame, protocol: str = "All", ip: str = "", port: str = "") -> DataFrame:
    """All given filters together; blank ones are ignored."""
    condition = protocol_matches(protocol)
    if ip.strip():
        condition = condition & either_contains("src_ip", "dst_ip", ip.strip())
    if port.strip():
        condition = condition & either_contains("src_port", "dst_port", port.strip())
    return df.filter(condition)


def http_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("protocol") == "HTTP")


def packet_by_id(df: DataFrame, packet_id: int) -> DataFrame:
    return df.filter(F.col("packet_id") == packet_id).limit(1)


def drop_blank(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows in which every one of the columns is NULL or empty."""
    return df.filter(any_of([has_text(F.col(c)) for c in columns or df.columns]))


def first_packets(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy("ts", "packet_id").limit(n)


def first_by_id(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` packets, as the raw view shows them."""
    return df.orderBy("packet_id").limit(n)


def last_packets(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("packet_id")).limit(n)


def first_seconds(df: DataFrame, seconds: int) -> DataFrame:
    """Rows of the first ``seconds`` after the earliest packet."""
    start = df.agg(F.min("ts")).scalar()
    return df.filter(F.col("ts") < start + F.make_dt_interval(secs=F.lit(seconds)))


def non_zero(df: DataFrame, count: str = "n") -> DataFrame:
    return df.filter(F.col(count) > 0)
