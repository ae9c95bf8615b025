"""Row shaping: cleaning, info text, raw lines, packet numbers, detail rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetscope.functions.addresses import packet_direction
from packetscope.functions.flags import flag_names
from packetscope.functions.text import has_text
from packetscope.plans.ordered import number_rows

_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def fill_by_type(df: DataFrame) -> DataFrame:
    """NULL text becomes empty, NULL numbers become 0."""
    text = [n for n, t in df.dtypes if t == "string"]
    numbers = [n for n, t in df.dtypes if t.startswith(_NUMBERS)]
    return df.fillna("", text).fillna(0, numbers)


def number_packets(df: DataFrame) -> DataFrame:
    """Add packet_no, 1..n in arrival order."""
    return number_rows(df, [F.col("ts"), F.col("packet_id")])


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def info_text() -> Column:
    """One-line summary of a packet, empty when a needed field is missing."""
    protocol = F.col("protocol")
    src, dst = F.col("src_ip"), F.col("dst_ip")
    ends = has_text(src) & has_text(dst)
    arrow = F.lit(" → ")
    with_ports = F.concat(
        src, F.lit(":"), _text("src_port"), arrow, dst, F.lit(":"), _text("dst_port")
    )
    request = F.concat(F.col("http_method"), F.lit(" "), F.col("http_path"))
    host = F.when(has_text(F.col("http_host")), F.concat(F.lit(" Host: "), F.col("http_host")))
    per_protocol = (
        F.when(protocol.isin("TCP", "UDP"), F.when(ends, with_ports))
        .when(protocol == "ICMP", F.when(ends, F.concat(F.lit("ICMP "), src, arrow, dst)))
        .when(
            protocol == "ARP",
            F.when(ends, F.concat(F.lit("Who has "), dst, F.lit("? Tell "), src)),
        )
        .when(
            protocol == "DNS",
            F.when(has_text(F.col("dns_query")), F.concat(F.lit("Query: "), F.col("dns_query"))),
        )
        .when(
            protocol == "HTTP",
            F.when(
                has_text(F.col("http_method")) & has_text(F.col("http_path")),
                F.concat(request, F.coalesce(host, F.lit(""))),
            ),
        )
        .otherwise(F.when(ends, F.concat(src, arrow, dst)))
    )
    return F.coalesce(per_protocol, F.lit(""))


def ts_text(ts: Column, millis: bool = False) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS" if millis else "yyyy-MM-dd HH:mm:ss")


_RAW_LINE = ["src_mac", "dst_mac", "src_ip", "dst_ip", "protocol", "length", "src_port", "dst_port"]


def raw_line(skip_empty: bool) -> Column:
    """Packet id and nine joined fields; a live view skips the empty ones."""
    fields = [ts_text(F.col("ts"))] + [_text(c) for c in _RAW_LINE]
    if skip_empty:
        fields = [F.nullif(f, F.lit("")) for f in fields]
    return F.concat(F.col("packet_id").cast("string"), F.lit(": "), F.concat_ws(", ", *fields))


VIEW_COLUMNS = [
    "packet_id", "timestamp", "src_mac", "dst_mac", "src_ip", "dst_ip", "src_port", "dst_port",
    "protocol", "length", "ttl", "tcp_flags", "tcp_window", "icmp_type", "icmp_code",
    "dns_query", "http_method", "http_host", "http_path", "packet_direction", "info",
]


def packet_view(df: DataFrame) -> DataFrame:
    """The columns a packet list shows, with flag names, direction and info text."""
    direction = (
        F.col("packet_direction")
        if "packet_direction" in df.columns
        else packet_direction(F.col("protocol"), F.col("src_ip"), F.col("dst_ip"))
    )
    made = {
        "timestamp": ts_text(F.col("ts")),
        "tcp_flags": flag_names(F.col("tcp_flags_mask")),
        "packet_direction": direction,
        "info": info_text(),
    }
    return df.select(*[(made[c] if c in made else F.col(c)).alias(c) for c in VIEW_COLUMNS])


def raw_dump(df: DataFrame) -> DataFrame:
    """All columns of every row as one text line, after a header line numbered -1."""
    lines = df.select(
        F.col("packet_id").alias("line_no"),
        F.concat_ws(", ", *[_text(c) for c in df.columns]).alias("line"),
    )
    header = df.sparkSession.range(1).select(
        F.lit(-1).cast("bigint").alias("line_no"), F.lit("# " + ", ".join(df.columns)).alias("line")
    )
    return header.unionByName(lines)


def _layer(when: Column, layer: str, fields: list[tuple[str, str]]) -> Column:
    rows = [
        F.struct(F.lit(layer).alias("layer"), F.lit(f).alias("field"), _text(c).alias("value"))
        for f, c in fields
    ]
    empty = F.array().cast("array<struct<layer:string,field:string,value:string>>")
    return F.when(when, F.array(*rows)).otherwise(empty)


def detail_rows(df: DataFrame) -> DataFrame:
    """(packet_id, layer, field, value): what a detail pane lists, layer by layer.

    Transport rows follow TCP, UDP and ICMP labels; application rows HTTP and DNS
    ones. Missing values are ``N/A``.
    """
    view = df.withColumns(
        {
            "__time": ts_text(F.col("ts")),
            "__flags": flag_names(F.col("tcp_flags_mask")),
            "__proto": F.upper(F.col("protocol")),
        }
    )
    proto = F.col("__proto")
    # fixed values: the field names below are those that readers of the detail pane know
    ports = [("Source Port", "src_port"), ("Destination Port", "dst_port")]
    layers = [
        _layer(
            F.lit(True),
            "frame",
            [
                ("Packet ID", "packet_id"),
                ("Timestamp", "__time"),
                ("Protocol", "__proto"),
                ("Length", "length"),
            ],
        ),
        _layer(
            F.lit(True), "ethernet", [("Source MAC", "src_mac"), ("Destination MAC", "dst_mac")]
        ),
        _layer(
            has_text(F.col("src_ip")) | has_text(F.col("dst_ip")),
            "network",
            [("Source IP", "src_ip"), ("Destination IP", "dst_ip"), ("TTL", "ttl")],
        ),
        _layer(
            proto == "TCP",
            "transport",
            [*ports, ("TCP Flags", "__flags"), ("Window Size", "tcp_window")],
        ),
        _layer(proto == "UDP", "transport", [*ports, ("UDP Length", "udp_length")]),
        _layer(
            proto == "ICMP", "transport", [("ICMP Type", "icmp_type"), ("ICMP Code", "icmp_code")]
        ),
        _layer(
            proto == "HTTP",
            "application",
            [
                ("HTTP Method", "http_method"),
                ("HTTP Host", "http_host"),
                ("HTTP Path", "http_path"),
            ],
        ),
        _layer(
            proto == "DNS",
            "application",
            [("DNS Query", "dns_query"), ("DNS Query Type", "dns_qtype")],
        ),
    ]
    rows = view.select("packet_id", F.inline(reduce(lambda a, b: F.concat(a, b), layers)))
    return rows.withColumn("value", F.coalesce(F.nullif("value", F.lit("")), F.lit("N/A")))
