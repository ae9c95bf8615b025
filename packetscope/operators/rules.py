"""Annotation and detection rules: each adds a short code, never prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetscope.constants import EICAR_MARKER, PROBE_PORTS
from packetscope.functions.addresses import direction
from packetscope.functions.flags import has_all, has_bit
from packetscope.functions.text import flag


def tcp_purpose(mask: Column) -> Column:
    """What the control bits are for; the first rule that fits."""
    return (
        F.when(has_all(mask, "SYN", "ACK"), F.lit("SYN_ACK"))
        .when(has_bit(mask, "SYN"), F.lit("SYN"))
        .when(has_all(mask, "FIN", "ACK"), F.lit("FIN_ACK"))
        .when(has_bit(mask, "FIN"), F.lit("FIN"))
        .when(has_bit(mask, "RST"), F.lit("RST"))
        .when(has_all(mask, "PSH", "ACK"), F.lit("PSH_ACK"))
        .when(has_bit(mask, "ACK"), F.lit("ACK"))
    )


def on_tcp(protocol: Column, value: Column) -> Column:
    """``value`` for packets labelled TCP; notes on control bits and windows are for those."""
    return F.when(F.upper(protocol) == "TCP", value)


def syn_fin(mask: Column) -> Column:
    return flag(has_all(mask, "SYN", "FIN"))


def syn_rst(mask: Column) -> Column:
    return flag(has_all(mask, "SYN", "RST"))


def flag_concern(
    protocol: Column, mask: Column, packet_direction: Column, dst_port: Column
) -> Column:
    """The first worrying reading of a TCP packet's control bits, else NULL."""
    return F.when(
        F.upper(protocol) == "TCP",
        F.when(has_all(mask, "SYN", "FIN"), F.lit("syn_fin"))
        .when(has_all(mask, "SYN", "RST"), F.lit("syn_rst"))
        .when(mask == 0, F.lit("null_scan"))
        .when(has_bit(mask, "RST") & (packet_direction == "Inbound"), F.lit("connection_rejected"))
        .when(has_bit(mask, "SYN") & (dst_port < 1024), F.lit("connection_request")),
    )


def findings(
    protocol: Column,
    mask: Column,
    packet_direction: Column,
    dst_port: Column,
    dst_ip: Column,
    dst_mac: Column,
) -> Column:
    """Array of finding codes, empty when nothing stands out."""
    name = F.upper(protocol)
    plain = F.when(name.isin("HTTP", "TELNET", "FTP"), F.lit("plaintext_protocol"))
    sealed = F.when(name.isin("HTTPS", "SSH", "SFTP"), F.lit("encrypted_protocol"))
    everyone = F.when(
        (dst_ip == "255.255.255.255") | (F.lower(dst_mac) == "ff:ff:ff:ff:ff:ff"),
        F.lit("broadcast"),
    )
    concern = flag_concern(protocol, mask, packet_direction, dst_port)
    return F.array_compact(F.array(concern, plain, everyone, sealed))


def packet_findings(df: DataFrame) -> Column:
    """``findings`` over the canonical packet columns, direction by address."""
    c = F.col
    return findings(
        c("protocol"),
        c("tcp_flags_mask"),
        direction(c("src_ip"), c("dst_ip")),
        c("dst_port"),
        c("dst_ip"),
        c("dst_mac"),
    )


def with_findings(df: DataFrame) -> DataFrame:
    """Add ``findings``: the codes joined in alphabetical order, or ``none``."""
    codes = F.array_join(F.array_sort(packet_findings(df)), ",")
    return df.withColumn("findings", F.coalesce(F.nullif(codes, F.lit("")), F.lit("none")))


def finding_counts(df: DataFrame) -> DataFrame:
    """Packets per finding, ``none`` for those without any."""
    codes = packet_findings(df)
    codes = F.when(F.size(codes) == 0, F.array(F.lit("none"))).otherwise(codes)
    return df.select(F.explode(codes).alias("finding")).groupBy("finding").agg(F.count("*").alias("n"))


def ttl_low(ttl: Column) -> Column:
    return flag(ttl < 64)


def ttl_very_low(ttl: Column) -> Column:
    return flag(ttl <= 30)


def window_class(window: Column) -> Column:
    return F.when(window < 1000, F.lit("small")).when(window > 65000, F.lit("large")).when(
        window.isNotNull(), F.lit("normal")
    )


def size_class(length: Column) -> Column:
    return F.when(length < 60, F.lit("small")).when(length > 1400, F.lit("large")).when(
        length.isNotNull(), F.lit("medium")
    )


def high_ports(src_port: Column, dst_port: Column) -> Column:
    """Ports above 1023, source first, joined by comma; empty when there is none."""
    return F.concat_ws(
        ", ",
        F.when(src_port > 1023, src_port.cast("string")),
        F.when(dst_port > 1023, dst_port.cast("string")),
    )


def port_meaning(protocol: Column, src_port: Column, dst_port: Column) -> Column:
    name = F.upper(protocol)

    def uses(port: int) -> Column:
        return F.coalesce(src_port == port, F.lit(False)) | F.coalesce(dst_port == port, F.lit(False))

    return (
        F.when((name == "TCP") & uses(80), F.lit("web"))
        .when((name == "TCP") & uses(443), F.lit("secure_web"))
        .when((name == "UDP") & uses(53), F.lit("name_lookup"))
    )


def http_meaning(method: Column) -> Column:
    return (
        F.when(method == "GET", F.lit("read"))
        .when(method == "POST", F.lit("submit"))
        .when(method == "HEAD", F.lit("check"))
    )


def direction_meaning(packet_direction: Column) -> Column:
    return (
        F.when(packet_direction == "Inbound", F.lit("incoming"))
        .when(packet_direction == "Outbound", F.lit("outgoing"))
        .otherwise(F.lit("other"))
    )


def protocol_tag(protocol: Column) -> Column:
    """Display tag; HTTP is tested before HTTPS and TLS, so HTTPS is tagged http."""
    name = F.upper(F.coalesce(protocol, F.lit("")))
    chain = None
    for tag in ("tcp", "udp", "icmp", "arp", "dns", "http"):
        test, value = name.contains(tag.upper()), F.lit(tag)
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain.when(name.contains("TLS") | name.contains("SSL"), F.lit("tls")).otherwise(
        F.lit("other")
    )


def with_signatures(df: DataFrame) -> DataFrame:
    """Add one 0/1 column per probe pattern seen in crafted traffic."""
    mask = F.col("tcp_flags_mask")
    probes = F.coalesce(F.col("src_port").isin(PROBE_PORTS), F.lit(False)) | F.coalesce(
        F.col("dst_port").isin(PROBE_PORTS), F.lit(False)
    )
    return df.withColumns(
        {
            "all_flags": flag(has_all(mask, "FIN", "SYN", "RST", "PSH", "ACK", "URG")),
            "syn_rst_fin": flag(has_all(mask, "SYN", "RST", "FIN")),
            "invalid_icmp": flag(F.col("icmp_type").between(41, 44) | (F.col("icmp_code") == 200)),
            "probe_port": flag(probes),
        }
    )


SIGNATURES = ["all_flags", "syn_rst_fin", "invalid_icmp", "probe_port"]


def signature_counts(df: DataFrame) -> DataFrame:
    """Packets per signature, zero rows included, from one global aggregate."""
    hits = with_signatures(df).agg(
        *[F.coalesce(F.sum(F.col(s).cast("bigint")), F.lit(0)).alias(s) for s in SIGNATURES]
    )
    pairs = [F.struct(F.lit(s).alias("signature"), F.col(s).alias("n")) for s in SIGNATURES]
    return hits.select(F.inline(F.array(*pairs)))


def with_frame_signatures(df: DataFrame) -> DataFrame:
    """The same for decoded frames: header oddities and the antivirus test marker.

    Needs ip_version, ip_flags, ip_fragment_offset, payload from the frame decoder.
    A fragment is tiny when the first or a middle piece carries under 128 bytes.
    """
    first_or_more = F.col("ip_flags").bitwiseAND(F.lit(1)) != 0
    return df.withColumns(
        {
            "bad_ip_version": flag(F.col("ip_version") != 4),
            "all_ip_flags": flag(F.col("ip_flags") == 7),
            "tiny_fragment": flag(first_or_more & (F.octet_length("payload") < 128)),
            "test_virus": flag(F.contains(F.col("payload"), F.lit(EICAR_MARKER.encode()))),
        }
    )
