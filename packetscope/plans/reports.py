"""Reports as long tables: (section, rank, key, n, pct).

Each report groups the packets once, by (section, key), and writes the counts. Protocol
labels are one of the sections and hold every packet, so totals, classes and the time span
come from the same rows as the lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetscope.functions.text import epoch_micros, has_text, percent
from packetscope.operators.filters import non_zero
from packetscope.operators.lookups import transport_of
from packetscope.operators.stats import (
    class_counts_exact,
    class_rows,
    top5_sections,
    top_per_section,
)
from packetscope.plans.ordered import number_rows
from packetscope.session import written


def _grouped(df: DataFrame, sections: dict[str, Column]) -> DataFrame:
    """``section, key, n, first, last`` of the sections and of ``protocol``, written.

    ``first`` and ``last`` are times of packets, for protocols. Packets without a value are
    left out, but for protocols, which count every packet. Tasks add up their own rows
    before the shuffle, so a hot address or label is one row a task.
    """
    keys = {"protocol": F.col("protocol"), **sections}
    pairs = [F.struct(F.lit(s).alias("section"), c.cast("string").alias("key")) for s, c in keys.items()]
    is_protocol = F.col("section") == "protocol"
    time = [F.col("ts")] if "ts" in df.columns else [F.lit(None).cast("timestamp").alias("ts")]
    long = df.select(*time, F.inline(F.array(*pairs))).filter(is_protocol | has_text(F.col("key")))
    at = F.when(is_protocol, F.col("ts"))
    counts = long.groupBy("section", "key").agg(
        F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last")
    )
    return written(counts, "report")


def _protocols(grouped: DataFrame) -> DataFrame:
    """Rows per protocol label, NULL included."""
    rows = grouped.filter("section = 'protocol'")
    return rows.select(F.col("key").alias("protocol"), "n", "first", "last")


def _count(rows: DataFrame, condition: Column | None = None) -> DataFrame:
    """One row ``n``: packets in all or in some of the protocols."""
    n = F.col("n") if condition is None else F.when(condition, F.col("n"))
    return rows.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n"))


def _single(section: str, one_row: DataFrame) -> DataFrame:
    return one_row.select(
        F.lit(section).alias("section"),
        F.lit(1).alias("rank"),
        F.lit("").alias("key"),
        "n",
        F.lit(None).cast("double").alias("pct"),
    )


def _classes(rows: DataFrame, kind: Column, shares: bool) -> DataFrame:
    """The four classes from per-protocol rows."""

    def of(name: str) -> Column:
        return F.coalesce(F.sum(F.when(kind == name, F.col("n"))), F.lit(0))

    total = F.coalesce(F.sum("n"), F.lit(0))
    counts = rows.agg(
        of("TCP").alias("tcp_packets"),
        of("UDP").alias("udp_packets"),
        of("ICMP").alias("icmp_packets"),
        (total - of("TCP") - of("UDP") - of("ICMP")).alias("other_packets"),
        total.alias("total_packets"),
    )
    names = F.array(*[F.lit(c) for c in ("TCP", "UDP", "ICMP", "Other")])
    return class_rows(counts).select(
        F.lit("class").alias("section"),
        F.array_position(names, F.col("protocol_class")).cast("int").alias("rank"),
        F.col("protocol_class").alias("key"),
        "n",
        (F.col("pct") if shares else F.lit(None).cast("double")).alias("pct"),
    )


def traffic_report(df: DataFrame, k: int = 10) -> DataFrame:
    """Protocol distribution, top sources, destinations and HTTP hosts, HTTP total.

    Shares are of all packets, for hosts of the HTTP packets. The protocol list
    is whole, the others hold ``k`` entries.
    """
    http_packets = F.col("protocol") == "HTTP"
    grouped = _grouped(
        df,
        {
            "source": F.col("src_ip"),
            "destination": F.col("dst_ip"),
            "http_host": F.when(http_packets, F.col("http_host")),
        },
    )
    rows = _protocols(grouped)
    total, http = _count(rows), _count(rows, http_packets)
    labelled = rows.filter(has_text(F.col("protocol")))
    # labels are an open set: sorted in ranges, not ranked by one task
    protocols = number_rows(labelled, [F.desc("n"), F.col("protocol")], "rank").select(
        F.lit("protocol").alias("section"), F.col("protocol").alias("key"), "n", F.col("rank").cast("int").alias("rank")
    )
    lists = top_per_section(grouped.filter("section <> 'protocol'").select("section", "key", "n"), k)
    ranked = protocols.unionByName(lists)
    base = F.when(F.col("section") == "http_host", http.scalar()).otherwise(total.scalar())
    shares = ranked.select("section", "rank", "key", "n", percent(F.col("n"), base, 2).alias("pct"))
    return (
        _single("total_packets", total)
        .unionByName(shares)
        .unionByName(_single("http_requests", http))
    )


_SECTION_ORDER = [
    "total_packets", "protocol", "source", "destination", "http_requests", "http_host",
]
# fixed values: headings of the text report
_HEADINGS = {
    "protocol": "Protocol Distribution:",
    "source": "Top Source IPs:",
    "destination": "Top Destination IPs:",
    "http_requests": "HTTP Statistics:",
    "http_host": "  Top Hosts:",
}


def report_lines(df: DataFrame, k: int = 10) -> DataFrame:
    """(section_no, line_no, line): the traffic report as text, in print order.

    Line 0 of a section is its heading. The host heading is left out when there
    are no HTTP packets.
    """
    report = traffic_report(df, k)
    number = F.array_position(F.array(*[F.lit(s) for s in _SECTION_ORDER]), F.col("section"))
    indent = F.when(F.col("section") == "http_host", F.lit("    ")).otherwise(F.lit("  "))
    entry = F.format_string("%s%s: %d (%.2f%%)", indent, F.col("key"), F.col("n"), F.col("pct"))
    line = (
        F.when(F.col("section") == "total_packets", F.format_string("Total Packets: %d", F.col("n")))
        .when(
            F.col("section") == "http_requests",
            F.format_string("  Total HTTP Requests: %d", F.col("n")),
        )
        .otherwise(entry)
    )
    body = report.select(
        number.cast("int").alias("section_no"), F.col("rank").alias("line_no"), line.alias("line")
    )
    http = report.filter("section = 'http_requests'").select("n").scalar()
    rows = ", ".join(
        f"({_SECTION_ORDER.index(s) + 1}, 0, '{text}')" for s, text in _HEADINGS.items()
    )
    headings = df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(section_no, line_no, line)")
    headings = headings.filter((F.col("line") != _HEADINGS["http_host"]) | (http > 0))
    return body.unionByName(headings).orderBy("section_no", "line_no")


def capture_summary(df: DataFrame) -> DataFrame:
    """(section, key, n, pct): totals, duration, transport shares, and every source,
    destination and port with its count, most frequent first.

    ``n`` of the duration row is whole milliseconds. Ports are the destination
    ports of TCP and UDP packets; shares have one decimal.
    """
    transport = transport_of(F.col("protocol"))
    grouped = _grouped(
        df,
        {
            "source": F.col("src_ip"),
            "destination": F.col("dst_ip"),
            "port": F.when(transport.isin("TCP", "UDP"), F.col("dst_port")),
        },
    )
    rows = _protocols(grouped)
    total = _count(rows)
    listed = grouped.filter("section <> 'protocol'")
    base = F.greatest(total.scalar(), F.lit(1))
    share = F.round(F.lit(100.0) * F.col("n") / base, 1)
    lists = listed.select("section", F.lit(None).cast("int").alias("rank"), "key", "n", share.alias("pct"))
    span = epoch_micros(F.max("last")) - epoch_micros(F.min("first"))
    duration = rows.agg(F.coalesce(F.round(span / 1000).cast("bigint"), F.lit(0)).alias("n"))
    parts = (
        _single("total_packets", total)
        .unionByName(_single("duration_ms", duration))
        .unionByName(_classes(rows, transport, shares=True))
        .unionByName(lists)
    )
    order = ["total_packets", "duration_ms", "class", "source", "destination", "port"]
    section = F.array_position(F.array(*[F.lit(name) for name in order]), F.col("section"))
    sorted_rows = parts.orderBy(section, "rank", F.desc("n"), F.col("key").try_cast("bigint"), "key")
    return sorted_rows.select("section", "key", "n", "pct")


def viewer_summary(df: DataFrame) -> DataFrame:
    """Total, class counts by label, and the five top sources, destinations and ports."""
    rows = df.groupBy("protocol").agg(F.count("*").alias("n"))
    lists = top5_sections(df).select(
        "section", "rank", "key", "n", F.lit(None).cast("double").alias("pct")
    )
    return (
        _single("total_packets", _count(rows))
        .unionByName(_classes(rows, F.col("protocol"), shares=False))
        .unionByName(lists)
    )


def protocol_chart(df: DataFrame) -> DataFrame:
    """(protocol_class, n, pct) of the classes that occur."""
    return non_zero(class_rows(class_counts_exact(df)))
