"""Counts, rates and top lists.

All counts are plain hash aggregates, so each task first combines its own rows
and a hot address or port costs no more than any other key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetscope.functions.addresses import packet_direction
from packetscope.functions.text import epoch_seconds, has_text, percent
from packetscope.operators.lookups import transport_of

CLASSES = ["TCP", "UDP", "ICMP", "Other"]


def total_packets(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Rows per value, rows without a value left out."""
    c = F.col(column)
    present = df.filter(has_text(c)) if dict(df.dtypes)[column] == "string" else df.filter(c.isNotNull())
    return present.groupBy(c.alias(name or column)).agg(F.count("*").alias("n"))


def top(counts: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """Most frequent first, ties by key; all of them without ``k``."""
    ordered = counts.orderBy(F.desc("n"), F.asc(key))
    return ordered if k is None else ordered.limit(k)


def with_share(counts: DataFrame, of: DataFrame, digits: int = 2) -> DataFrame:
    """Add ``pct``: share of all rows of ``of``, also those without a key."""
    total = of.agg(F.count("*")).scalar()
    return counts.withColumn("pct", percent(F.col("n"), total, digits))


def top_share(df: DataFrame, column: str, k: int, digits: int = 2) -> DataFrame:
    return with_share(top(value_counts(df, column), column, k), df, digits)


def protocol_distribution(df: DataFrame) -> DataFrame:
    """Protocol counts with share; a table with no protocol column is one ``N/A`` bucket."""
    if "protocol" not in df.columns:
        return df.agg(F.count("*").alias("n")).select(
            F.lit("N/A").alias("protocol"), "n", percent(F.col("n"), F.col("n"), 2).alias("pct")
        )
    return with_share(value_counts(df, "protocol"), df)


def counts_or_missing(df: DataFrame, columns: dict[str, str], k: int = 10) -> DataFrame:
    """(section, key, n) top lists; a section whose column is absent is one ``N/A`` bucket."""
    present = [(s, c) for s, c in columns.items() if c in df.columns]
    missing = [s for s, c in columns.items() if c not in df.columns]
    parts = []
    if present:
        parts.append(top_per_section(section_counts(df, present), k).drop("rank"))
    for section in missing:
        parts.append(
            df.agg(F.count("*").alias("n")).select(
                F.lit(section).alias("section"), F.lit("N/A").alias("key"), "n"
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def class_counts(df: DataFrame, kind: Column) -> DataFrame:
    """One row with tcp, udp, icmp, other and total packets."""
    return df.agg(
        F.count_if(kind == "TCP").alias("tcp_packets"),
        F.count_if(kind == "UDP").alias("udp_packets"),
        F.count_if(kind == "ICMP").alias("icmp_packets"),
        F.count_if(~F.coalesce(kind.isin("TCP", "UDP", "ICMP"), F.lit(False))).alias("other_packets"),
        F.count("*").alias("total_packets"),
    )


def class_counts_exact(df: DataFrame) -> DataFrame:
    """By the protocol label as it stands."""
    return class_counts(df, F.col("protocol"))


def class_counts_layer(df: DataFrame) -> DataFrame:
    """By the transport under the label, so HTTP counts as TCP and DNS as UDP."""
    return class_counts(df, transport_of(F.col("protocol")))


def class_rows(classes: DataFrame, digits: int = 1) -> DataFrame:
    """The one-row class counts as (protocol_class, n, pct), guarded against an empty table."""
    total = F.greatest("total_packets", F.lit(1))
    pairs = [
        F.struct(
            F.lit(c).alias("protocol_class"),
            F.col(f"{c.lower()}_packets").alias("n"),
            F.round(F.lit(100.0) * F.col(f"{c.lower()}_packets") / total, digits).alias("pct"),
        )
        for c in CLASSES
    ]
    return classes.select(F.inline(F.array(*pairs)))


def transport_rows(df: DataFrame) -> DataFrame:
    return df.filter(transport_of(F.col("protocol")).isin("TCP", "UDP"))


def dst_port_counts(df: DataFrame) -> DataFrame:
    """Destination ports of TCP and UDP packets."""
    return value_counts(transport_rows(df), "dst_port")


def port_counts(df: DataFrame) -> DataFrame:
    """Ports of both ends; a packet with two equal ports counts twice."""
    both = df.select(F.explode(F.array("src_port", "dst_port")).alias("port"))
    return value_counts(both, "port")


def with_direction(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "packet_direction", packet_direction(F.col("protocol"), F.col("src_ip"), F.col("dst_ip"))
    )


def direction_counts(df: DataFrame) -> DataFrame:
    counted = with_direction(df).filter(
        F.col("packet_direction").isin("Inbound", "Outbound", "Local", "External")
    )
    return counted.groupBy("packet_direction").agg(F.count("*").alias("n"))


def _distinct_parts(df: DataFrame) -> DataFrame:
    """(field, value) for the five sets a capture keeps, transport names included."""
    transport = transport_of(F.col("protocol"))
    on_port = transport.isin("TCP", "UDP")
    pairs = [
        ("source_ips", F.col("src_ip")),
        ("dest_ips", F.col("dst_ip")),
        ("source_ports", F.when(on_port, F.col("src_port").cast("string"))),
        ("dest_ports", F.when(on_port, F.col("dst_port").cast("string"))),
        ("protocols", F.nullif(F.col("protocol"), F.lit("Unknown"))),
        ("protocols", F.when(on_port, transport)),
    ]
    parts = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in pairs])
    return df.select(F.inline(parts)).filter(F.col("value").isNotNull())


def distinct_counts(df: DataFrame) -> DataFrame:
    """Exact number of distinct values per field.

    Two plain counts (per value, then per field) instead of a distinct aggregate
    per column: one shuffle on (field, value), hot values combined map-side.
    """
    values = _distinct_parts(df).groupBy("field", "value").agg(F.lit(1).alias("one"))
    return values.groupBy("field").agg(F.count("*").alias("n_distinct"))


def distinct_counts_approx(df: DataFrame, error: float = 0.02) -> DataFrame:
    """Sketch-based version: constant state per field however many values there are."""
    return _distinct_parts(df).groupBy("field").agg(
        F.approx_count_distinct("value", error).alias("n_distinct")
    )


def app_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(F.col("protocol") == "HTTP").alias("http_packets"),
        F.count_if(F.col("protocol") == "DNS").alias("dns_packets"),
    )


def http_hosts(df: DataFrame, k: int = 10) -> DataFrame:
    """Top hosts of HTTP rows with their share of all HTTP rows."""
    rows = df.filter(F.col("protocol") == "HTTP")
    return top_share(rows, "http_host", k)


def capture_span(df: DataFrame) -> DataFrame:
    """First and last packet time and the seconds between."""
    ends = df.agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    return ends.withColumn("seconds", _span(F.col("start_ts"), F.col("end_ts")))


def _span(start: Column, end: Column) -> Column:
    return F.round(epoch_seconds(end) - epoch_seconds(start), 6)


def rates(df: DataFrame) -> DataFrame:
    """Packets, bytes and both per second; 0 when no time has passed."""
    sums = df.agg(
        F.count("*").alias("total_packets"),
        F.coalesce(F.sum(F.col("length").cast("bigint")), F.lit(0)).alias("total_bytes"),
        _span(F.min("ts"), F.max("ts")).alias("seconds"),
    )

    def per_second(name: str) -> Column:
        return F.when(F.col("seconds") > 0, F.round(F.col(name) / F.col("seconds"), 6)).otherwise(
            F.lit(0.0)
        )

    return sums.select(
        "total_packets",
        "total_bytes",
        "seconds",
        per_second("total_packets").alias("packet_rate"),
        per_second("total_bytes").alias("byte_rate"),
    )


def protocol_menu(df: DataFrame) -> DataFrame:
    """Choices of the protocol filter: All, the protocols seen in order, Other."""
    seen = df.filter(has_text(F.col("protocol"))).select("protocol").distinct()
    extra = df.sparkSession.sql(
        "SELECT * FROM VALUES (0, 'All'), (2, 'Other') AS t(position, protocol)"
    )
    return (
        seen.select(F.lit(1).alias("position"), "protocol")
        .unionByName(extra)
        .orderBy("position", "protocol")
    )


def label_counts(features: DataFrame, label: str = "is_threat") -> DataFrame:
    return features.agg(
        F.coalesce(F.sum(F.col(label).cast("bigint")), F.lit(0)).alias("threats"),
        F.count("*").alias("packets"),
    )


def raw_counters(df: DataFrame) -> DataFrame:
    """Frame counters by protocol number: TCP, UDP, ICMP, ARP and the rest."""
    number = F.col("ip_proto")
    return df.agg(
        F.count_if(number == 6).alias("tcp_count"),
        F.count_if(number == 17).alias("udp_count"),
        F.count_if(number == 1).alias("icmp_count"),
        F.count_if(number == 2054).alias("arp_count"),
        F.count_if(~F.coalesce(number.isin(1, 6, 17, 2054), F.lit(False))).alias("other_count"),
        F.count("*").alias("total_count"),
    )


def section_counts(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """(section, key, n) for several columns in one scan and one shuffle.

    A section named twice counts the values of both its columns.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(s).alias("section"), F.col(c).cast("string").alias("key"))
            for s, c in columns
        ]
    )
    long = df.select(F.inline(pairs)).filter(has_text(F.col("key")))
    return long.groupBy("section", "key").agg(F.count("*").alias("n"))


def top_per_section(
    counts: DataFrame, k: int | None, numeric: tuple[str, ...] = ()
) -> DataFrame:
    """The ``k`` most frequent keys of every section, ties by key; all without ``k``.

    The rank filter lets Spark cut each task's rows to k per section before the
    shuffle, so one section with most of the keys is no bottleneck. Leave ``k``
    out only for closed sets such as protocol labels. Sections in ``numeric``
    break ties by number.
    """
    as_number = F.when(F.col("section").isin(list(numeric)), F.col("key").try_cast("bigint"))
    order = W.partitionBy("section").orderBy(F.desc("n"), as_number, "key")
    ranked = counts.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def top5_sections(df: DataFrame) -> DataFrame:
    """Five most frequent sources, destinations and ports (both ends)."""
    sections = [
        ("source", "src_ip"), ("destination", "dst_ip"), ("port", "src_port"), ("port", "dst_port"),
    ]
    return top_per_section(section_counts(df, sections), 5, numeric=("port",))
