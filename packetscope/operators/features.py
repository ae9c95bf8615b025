"""Feature tables and rule labels for the threat classifier.

The label is an OR of columns that are also features, so a model can learn it
exactly; its scores say nothing about real threats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetscope.constants import (
    BASIC_FEATURES,
    BASIC_LABEL_RULES,
    DETAILED_FEATURES,
    DETAILED_LABEL_RULES,
    MALWARE_DOMAINS,
    SUSPICIOUS_PATHS,
    SUSPICIOUS_PORTS,
    SUSPICIOUS_TLDS,
)
from packetscope.functions.addresses import private_registry
from packetscope.functions.flags import has_bit, suspicious
from packetscope.functions.text import flag, has_text, mentions, protocol_mentions, to_number
from packetscope.operators.stats import with_direction

LABEL = "is_threat"


def suspicious_port(port: Column) -> Column:
    return flag(port.isin(SUSPICIOUS_PORTS))


def obsolete_tls(version: Column, text: Column | None = None) -> Column:
    """SSL 3.0 or TLS 1.0 by number, or by name where the version came as text."""
    old = version.isin(768, 769)
    if text is not None:
        named = text.contains("1.0") | text.contains("SSL")
        old = F.coalesce(old, F.lit(False)) | F.coalesce(named, F.lit(False))
    return flag(old)


def _shared(df: DataFrame) -> dict[str, Column]:
    """Features both tables have, under the detailed table's names."""
    protocol = F.col("protocol")
    mask = F.col("tcp_flags_mask")
    length = to_number(F.col("length"))
    ttl = to_number(F.col("ttl"))
    return {
        "protocol_str": F.coalesce(protocol, F.lit("")),
        **{
            f"is_{name.lower()}": protocol_mentions(protocol, name)
            for name in ("TCP", "UDP", "ICMP", "HTTP", "DNS", "TLS", "SNMP", "DHCP", "ARP")
        },
        "src_ip_is_private": private_registry(F.col("src_ip")),
        "dst_ip_is_private": private_registry(F.col("dst_ip")),
        "src_port_suspicious": suspicious_port(F.col("src_port")),
        "dst_port_suspicious": suspicious_port(F.col("dst_port")),
        "has_suspicious_flags": suspicious(mask),
        **{
            f"has_{name.lower()}": flag(has_bit(mask, name))
            for name in ("SYN", "RST", "FIN", "ACK", "PSH", "URG")
        },
        "packet_length": length,
        "is_large_packet": flag(length > 1500),
        "ttl": ttl,
        "has_low_ttl": flag(ttl < 32),
        "has_dns_query": flag(has_text(F.col("dns_query"))),
        "has_suspicious_dns_query": flag(mentions(F.col("dns_query"), SUSPICIOUS_TLDS)),
        "has_http_method": flag(has_text(F.col("http_method"))),
        "has_suspicious_http_path": flag(mentions(F.col("http_path"), SUSPICIOUS_PATHS)),
        "has_suspicious_http_host": flag(mentions(F.col("http_host"), MALWARE_DOMAINS)),
    }


def _detailed_only(df: DataFrame) -> dict[str, Column]:
    method = F.upper(F.col("http_method"))
    status = F.col("http_status").cast("string")
    opcode = F.lower(F.col("arp_opcode"))
    version_text = F.col("tls_version_text") if "tls_version_text" in df.columns else None
    return {
        "is_http_get": flag(method.contains("GET")),
        "is_http_post": flag(method.contains("POST")),
        "is_icmp_scan": flag((F.col("icmp_type") == 8) & (F.col("icmp_code") == 0)),
        "has_tls_info": flag(
            has_text(F.col("tls_version") if version_text is None else F.coalesce(version_text, F.col("tls_version").cast("string")))
        ),
        "has_obsolete_tls": obsolete_tls(F.col("tls_version"), version_text),
        "is_arp_request": flag(opcode.contains("request")),
        "is_arp_reply": flag(opcode.contains("reply")),
        "udp_length_val": to_number(F.col("udp_length")),
        "http_status_client_error": flag(status.startswith("4")),
        "http_status_server_error": flag(status.startswith("5")),
        "dns_qtype_is_any": flag(F.col("dns_qtype") == 255),
        "tls_is_handshake": flag(F.col("tls_content_type") == 22),
        "tls_is_app_data": flag(F.col("tls_content_type") == 23),
        "tls_is_client_hello": flag(F.col("tls_handshake_type") == 1),
    }


def _label(features: DataFrame, rules: list[str]) -> DataFrame:
    return features.withColumn(LABEL, F.greatest(*rules))


def _keys(df: DataFrame) -> list[Column]:
    return [F.col("packet_id")] if "packet_id" in df.columns else []


def basic_features(df: DataFrame) -> DataFrame:
    """packet_id (if any), 27 features and the label."""
    flow = (df if "packet_direction" in df.columns else with_direction(df)).withColumn(
        "__direction", F.col("packet_direction")
    )
    known = _shared(df)
    known["is_inbound"] = flag(F.col("__direction").contains("Inbound"))
    known["is_outbound"] = flag(F.col("__direction").contains("Outbound"))

    def pick(name: str) -> Column:
        return known[name if name in known else name.removesuffix("_basic")].alias(name)

    table = flow.select(*_keys(df), *[pick(n) for n in BASIC_FEATURES])
    return _label(table, BASIC_LABEL_RULES)


def detailed_features(df: DataFrame) -> DataFrame:
    """packet_id (if any), 44 features and the label."""
    known = {**_shared(df), **_detailed_only(df)}
    table = df.select(*_keys(df), *[known[n].alias(n) for n in DETAILED_FEATURES])
    return _label(table, DETAILED_LABEL_RULES)


def ensure_columns(df: DataFrame, expected: list[str]) -> DataFrame:
    """Add every expected column that is missing as 0, and put them in order."""
    missing = {c: F.lit(0) for c in expected if c not in df.columns}
    others = [c for c in df.columns if c not in expected]
    return df.withColumns(missing).select(*others, *expected)


def features_in_order(features: DataFrame, stored: list[str]) -> DataFrame:
    """Feature columns in stored order, label dropped; columns not there are skipped."""
    return features.select(*[c for c in stored if c in features.columns])


def column_kinds(features: DataFrame, label: str = LABEL) -> tuple[list[str], list[str]]:
    """Names of the numeric and of the text feature columns."""
    numeric, text = [], []
    for name, kind in features.dtypes:
        if name in (label, "packet_id"):
            continue
        (text if kind == "string" else numeric).append(name)
    return numeric, text


def scored(df: DataFrame) -> DataFrame:
    """Rule score for metric checks: share of five rules fired against the full label."""
    rules = [
        "src_port_suspicious", "dst_port_suspicious", "has_suspicious_flags",
        "has_suspicious_http_path", "has_suspicious_dns_query",
    ]
    table = detailed_features(df)
    fired = sum((F.col(r) for r in rules[1:]), F.col(rules[0]))
    return table.select(
        "packet_id",
        F.col(LABEL).alias("label"),
        (fired.cast("double") / len(rules)).alias("score"),
        (fired > 0).cast("int").alias("prediction"),
    )
