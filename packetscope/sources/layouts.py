"""Capture layouts: typed packets to layout rows and back.

``to_layout`` renders canonical packets as one of the five text layouts;
``normalise`` reads any of them (or any other header the alias table knows) into
the canonical columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetscope.constants import (
    ALIASES,
    BASIC_COLUMNS,
    DETAILED_COLUMNS,
    DETAILED_MARKERS,
    RAW_COLUMNS,
    SENTINELS,
    SAVED_COLUMNS,
    TSHARK_COLUMNS,
)
from packetscope.functions.addresses import frame_direction, packet_direction
from packetscope.functions.flags import flag_mask, flag_names
from packetscope.functions.text import epoch_seconds, to_int, to_long, utc_clock
from packetscope.operators.lookups import protocol_fallback, transport_of
from packetscope.operators.shaping import ts_text

LAYOUTS = {
    "basic": BASIC_COLUMNS,
    "detailed": DETAILED_COLUMNS,
    "raw": RAW_COLUMNS,
    "tshark": TSHARK_COLUMNS,
    "saved": SAVED_COLUMNS,
}

# Canonical columns in order; text comes last in doubt.
CANONICAL = {
    "packet_no": "bigint",
    "ts": "timestamp_ntz",
    "src_mac": "string",
    "dst_mac": "string",
    "src_ip": "string",
    "dst_ip": "string",
    "src_port": "int",
    "dst_port": "int",
    "protocol": "string",
    "length": "int",
    "ttl": "int",
    "tcp_flags": "string",
    "tcp_flags_mask": "int",
    "tcp_window": "int",
    "icmp_type": "int",
    "icmp_code": "int",
    "dns_query": "string",
    "http_method": "string",
    "http_host": "string",
    "http_path": "string",
    "packet_direction": "string",
    "raw_data": "string",
    "ip_proto": "int",
    "identification": "int",
    "udp_length": "int",
    "udp_checksum": "string",
    "http_status": "int",
    "dns_id": "int",
    "dns_qr": "int",
    "dns_opcode": "int",
    "dns_qtype": "int",
    "dns_ans_name": "string",
    "dns_ans_rdata": "string",
    "dns_ans_type": "int",
    "arp_opcode": "string",
    "arp_src_mac": "string",
    "arp_src_ip": "string",
    "arp_dst_mac": "string",
    "arp_dst_ip": "string",
    "dhcp_type": "string",
    "snmp_community": "string",
    "snmp_pdu": "string",
    "snmp_request_id": "bigint",
    "snmp_oid": "string",
    "snmp_value": "string",
    "tls_content_type": "int",
    "tls_version": "int",
    "tls_version_text": "string",
    "tls_handshake_type": "int",
}


class LayoutError(ValueError):
    """A capture with no usable header, or a path that is not there."""


def layout_schema(layout: str) -> T.StructType:
    """All-text schema of a layout; numbers are parsed after the sentinels are gone."""
    return T.StructType([T.StructField(c, T.StringType()) for c in LAYOUTS[layout]])


def detect_layout(columns: list[str]) -> str:
    return "detailed" if any(c in columns for c in DETAILED_MARKERS) else "basic"


_SENTINELS = ", ".join(f"'{s}'" for s in SENTINELS)


def _first_alias(columns: list[str], name: str) -> str | None:
    return next((a for a in ALIASES[name] if a in columns), None)


def normalise(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Canonical packets from text rows under any known header; absent fields are NULL.

    Columns named in ``keep`` come first, as they are.
    """
    columns = df.columns

    def text(name: str) -> Column:
        alias = _first_alias(columns, name)
        if alias is None:
            return F.lit(None).cast("string")
        return F.expr(f"CASE WHEN `{alias}` NOT IN ({_SENTINELS}) THEN `{alias}` END")

    # hex control bits such as 0x0012 win over names where a layout has them
    hex_bits = F.conv(F.regexp_extract(text("tcp_flags_hex"), r"^0x([0-9a-fA-F]+)$", 1), 16, 10)
    bits = hex_bits.try_cast("int")
    # ``None`` in a flag column means "no bit set", unlike everywhere else
    flags = _first_alias(columns, "tcp_flags")
    names = F.lit(None).cast("string")
    if flags is not None:
        raw = F.col(f"`{flags}`").cast("string")
        names = F.when(~raw.isin("", "N/A"), raw)
    seconds = text("time_epoch").try_cast("decimal(20,6)")
    wall = F.coalesce(
        text("timestamp").try_cast("timestamp_ntz"),
        utc_clock(F.timestamp_seconds(seconds)),
    )
    made = {
        "ts": wall,
        "tcp_flags": F.coalesce(names, flag_names(bits)),
        "tcp_flags_mask": F.coalesce(bits, flag_mask(names)).cast("int"),
        "tls_version": to_int(text("tls_version_text")),
        "protocol": F.coalesce(text("protocol"), protocol_fallback(to_int(text("ip_proto")))),
    }

    def typed(name: str, kind: str) -> Column:
        if name in made:
            return made[name]
        raw = text(name)
        if name == "identification":
            hex_digits = F.nullif(F.regexp_extract(raw, r"^0[xX]([0-9a-fA-F]+)$", 1), F.lit(""))
            return F.coalesce(to_int(raw), F.conv(hex_digits, 16, 10).try_cast("int"))
        if kind == "int":
            return to_int(raw)
        return to_long(raw) if kind == "bigint" else raw

    return df.select(*(keep or []), *[typed(n, k).alias(n) for n, k in CANONICAL.items()])


def to_layout(df: DataFrame, layout: str, keep: list[str] | None = None) -> DataFrame:
    """Canonical packets as text rows of a layout, missing values as its writers put them.

    Columns named in ``keep`` come first, as they are.
    """
    if layout not in LAYOUTS:
        raise LayoutError(f"unknown layout {layout!r}, expected one of {sorted(LAYOUTS)}")
    have = set(df.columns)

    def c(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None)

    def direction() -> Column:
        if layout == "raw":
            return frame_direction(
                c("protocol"), c("arp_opcode"), c("src_ip"), c("dst_ip"), c("dst_mac")
            )
        return packet_direction(c("protocol"), c("src_ip"), c("dst_ip"))

    def flag_text() -> Column:
        if layout == "raw":
            return F.nullif(flag_names(c("tcp_flags_mask"), " ", 6), F.lit("None"))
        return flag_names(c("tcp_flags_mask"))

    def tcp_only(name: str) -> Column:
        return F.when(transport_of(c("protocol")) == "TCP", c(name))

    # columns that are not just a canonical one written as text
    rendered = {
        "timestamp": lambda: ts_text(c("ts"), millis=layout == "raw"),
        "Time": lambda: ts_text(c("ts")),
        "frame.time_epoch": lambda: F.format_string("%.6f", epoch_seconds(c("ts"))),
        "packet_direction": direction,
        "#": lambda: c("packet_no" if "packet_no" in have else "packet_id"),
        "TCP Flags": lambda: F.nullif(flag_names(c("tcp_flags_mask"), "+"), F.lit("None")),
        "tcp_flags": flag_text,
        "tcp.flags": lambda: F.concat(
            F.lit("0x"), F.lpad(F.lower(F.hex(c("tcp_flags_mask"))), 4, "0")
        ),
        "TLS Version": lambda: c("tls_version"),
        "tcp.srcport": lambda: tcp_only("src_port"),
        "tcp.dstport": lambda: tcp_only("dst_port"),
    }
    absent = F.lit("" if layout in ("detailed", "tshark", "saved") else "N/A")
    canonical = {alias: name for name, aliases in ALIASES.items() for alias in aliases}
    cells = []
    for column in LAYOUTS[layout]:
        value = rendered[column]() if column in rendered else c(canonical[column])
        cells.append(F.coalesce(value.cast("string"), absent).alias(column))
    return df.select(*(keep or []), *cells)


def normalise_union(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of several captures as one canonical table, each under its name in ``layout``."""
    named = [normalise(rows).withColumn("layout", F.lit(name)) for name, rows in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), named)
