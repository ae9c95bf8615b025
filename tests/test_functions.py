import ipaddress

import pytest
from pyspark.sql import functions as F

from packetscope.functions import addresses, flags, text
from packetscope.operators import encode, filters, lookups, rules
from packetscope.operators.features import (
    BASIC_FEATURES,
    DETAILED_FEATURES,
    basic_features,
    column_kinds,
    detailed_features,
    obsolete_tls,
)
from packetscope.operators.shaping import detail_rows, info_text

ADDRESSES = [
    "10.1.2.3", "9.255.255.255", "11.0.0.0", "127.0.0.1", "172.15.0.1", "172.16.0.1",
    "172.31.255.255", "172.32.0.1", "192.168.0.1", "192.169.0.1", "169.254.1.1", "0.0.0.0",
    "1.0.0.0", "192.0.0.8", "192.0.0.9", "192.0.0.10", "192.0.0.11", "192.0.0.170", "192.0.1.1",
    "192.0.2.1", "198.17.0.1", "198.18.0.1", "198.19.255.1", "198.20.0.1", "198.51.100.7",
    "198.51.101.7", "203.0.113.1", "203.0.114.1", "224.0.0.1", "239.1.1.1", "240.0.0.1",
    "255.255.255.255", "100.64.0.1", "8.8.8.8", "93.184.0.34", "256.1.1.1", "1.2.3", "01.2.3.4",
    "10.0.0.1\n", "::1", "::", "::2", "fe80::1", "fe80::1%eth0", "febf::1", "fec0::1", "fc00::1",
    "fdff:1::", "2001:db8::1", "2001:db9::1", "2001::1", "2001:1::1", "2001:1::2", "2001:1::3",
    "2001:3::7", "2001:4:112::1", "2001:20::5", "2001:30::5", "2001:200::1", "2002::1",
    "64:ff9b::1", "64:ff9b:1::1", "100::1", "100:0:0:1::1", "2606:4700::1111",
    "::ffff:10.0.0.1", "::ffff:8.8.8.8", "::ffff:0a00:0001", "::ffff:c000:9", "1:2:3:4:5:6:7:8",
    "1:2:3:4:5:6:7", "1::2::3", "12345::1", "g::1", "fe80:0:0:0:0:0:0:1", "FE80::A", "1:2:3:4:5:6:7::",
    ":1:2:3:4:5:6:7", "::1:2:3:4:5:6:7:8", "N/A", "",
]


def private_by_library(ip: str) -> int:
    try:
        found = ipaddress.ip_address(ip)
    except ValueError:
        return 0
    mapped = getattr(found, "ipv4_mapped", None)
    return int((mapped or found).is_private)


def test_registry_agrees_with_the_standard_library(spark):
    frame = spark.createDataFrame([(a,) for a in ADDRESSES] + [(None,)], "ip string")
    got = {
        r.ip: r.p for r in frame.select("ip", addresses.private_registry(F.col("ip")).alias("p")).collect()
    }
    assert got.pop(None) == 0
    assert got == {a: private_by_library(a) for a in ADDRESSES}


def test_prefix_rule_on_edges(spark):
    frame = spark.createDataFrame(
        [("172.15.0.1", 0), ("172.16.0.1", 1), ("172.31.9.9", 1), ("172.32.0.1", 0), ("10.0.0.1", 1),
         ("100.0.0.1", 0), ("198.51.100.1", 0), ("127.0.0.1", 1), (None, 0)],
        "ip string, want int",
    )
    assert frame.filter(addresses.private_prefix(F.col("ip")) != F.col("want")).count() == 0


def test_direction_and_context_agree(spark):
    ips = [(a,) for a in ("10.0.0.1", "8.8.8.8", "192.168.3.4", "198.51.100.1")]
    pairs = spark.createDataFrame([(a[0], b[0]) for a in ips for b in ips], "s string, d string")
    both = pairs.select(
        addresses.direction(F.col("s"), F.col("d")).alias("way"),
        addresses.network_context(F.col("s"), F.col("d")).alias("context"),
    ).distinct()
    assert {(r.way, r.context) for r in both.collect()} == {
        ("Local", "internal"), ("Outbound", "internal_to_external"),
        ("Inbound", "external_to_internal"), ("External", "external"),
    }
    nothing = spark.createDataFrame([(None, None)], "s string, d string")
    assert nothing.select(addresses.direction(F.col("s"), F.col("d"))).first()[0] == "Unknown"


def test_flag_names_and_mask_are_inverse_for_all_masks(spark):
    masks = spark.range(256).select(F.col("id").cast("int").alias("m"))
    for separator in (" ", "+"):
        back = flags.flag_mask(flags.flag_names(F.col("m"), separator))
        assert masks.filter(back != F.col("m")).count() == 0
    assert masks.filter("m = 18").select(flags.flag_names(F.col("m"), "+")).first()[0] == "SYN+ACK"
    assert masks.filter("m = 0").select(flags.flag_names(F.col("m"))).first()[0] == "None"


def test_suspicious_flags(spark):
    masks = spark.range(64).select(F.col("id").cast("int").alias("m"))
    got = {r.m for r in masks.filter(flags.suspicious(F.col("m")) == 1).collect()}
    assert got == {m for m in range(64) if m & 20 == 20 or m & 5 == 5 or m & 3 == 3}


@pytest.mark.parametrize(
    "seconds,want",
    [(0.0, "0.0 seconds"), (59.96, "60.0 seconds"), (60.0, "1 minutes 0 seconds"),
     (3599.9, "59 minutes 59 seconds"), (3600.0, "1 hours 0 minutes"), (90061.0, "25 hours 1 minutes")],
)
def test_readable_seconds(spark, seconds, want):
    row = spark.range(1).select(text.readable_seconds(F.lit(seconds)).alias("t")).first()
    assert row.t == want


def test_number_parsing(spark):
    frame = spark.createDataFrame([("80.7",), ("80.0",), ("x",), (None,), ("N/A",), ("-3",)], "t string")
    rows = frame.select(text.to_int(F.col("t")).alias("i"), text.to_number(F.col("t")).alias("d")).collect()
    assert [r.i for r in rows] == [80, 80, None, None, None, -3]
    assert [r.d for r in rows] == [80.7, 80.0, 0.0, 0.0, 0.0, -3.0]


def test_text_helpers(spark):
    frame = spark.createDataFrame([(bytearray(b"a\xffb\xe2\x82"),)], "b binary")
    assert frame.select(text.safe_decode(F.col("b"))).first()[0] == "ab"
    one = spark.range(1)
    assert one.select(text.hex_text(F.lit(0))).first()[0] == ""
    assert one.select(text.hex_text(F.lit(48879))).first()[0] == "0xbeef"
    assert one.select(text.percent(F.lit(1), F.lit(0), 2)).first()[0] is None
    mac = one.select(addresses.mac_text(F.unhex(F.lit("0200AABBCCFF")))).first()[0]
    assert mac == "02:00:aa:bb:cc:ff"


def test_raw_data_text_round_trip(spark):
    cases = [
        ("[1, 2, 255]", b"\x01\x02\xff"), ("[]", b""), ("[1, 256]", b"[1, 256]"),
        ("[1, x]", b"[1, x]"), ("é", b"\xe9"), ("→", "→".encode()), ("", None), (None, None),
    ]
    frame = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    got = [r[0] for r in frame.select(encode.parse_raw_data(F.col("t"))).collect()]
    assert [None if g is None else bytes(g) for g in got] == [w for _, w in cases]
    raw = spark.createDataFrame([(bytearray(range(256)),), (bytearray(),)], "b binary")
    back = raw.select("b", encode.parse_raw_data(encode.byte_list_text(F.col("b"))).alias("x"))
    assert back.filter("b = x").count() == 2


def test_obsolete_tls_by_number_and_text(spark):
    frame = spark.createDataFrame(
        [(768, None, 1), (769, None, 1), (771, None, 0), (None, "TLS 1.0", 1), (None, "SSLv3", 1),
         (None, "TLS 1.3", 0), (None, None, 0)],
        "v int, t string, want int",
    )
    assert frame.filter(obsolete_tls(F.col("v"), F.col("t")) != F.col("want")).count() == 0


def test_feature_tables_hold_their_columns(packets):
    basic, detailed = basic_features(packets), detailed_features(packets)
    assert basic.columns == ["packet_id", *BASIC_FEATURES, "is_threat"]
    assert detailed.columns == ["packet_id", *DETAILED_FEATURES, "is_threat"]
    assert (len(BASIC_FEATURES), len(DETAILED_FEATURES)) == (27, 44)
    numeric, words = column_kinds(detailed)
    assert words == ["protocol_str"] and len(numeric) == 43


def test_label_is_at_least_every_indicator(packets):
    table = detailed_features(packets)
    assert table.filter("is_threat < dst_port_suspicious OR is_threat < tls_is_handshake").count() == 0


def test_filters(packets):
    n = packets.count()
    assert filters.filter_packets(packets).count() == n
    other = filters.filter_packets(packets, protocol="Other").count()
    usual = sum(filters.filter_packets(packets, protocol=p).count() for p in ("tcp", "UDP", "icmp", "ARP"))
    assert other + usual == n


def test_other_matches_a_protocol_of_that_name(spark):
    frame = spark.createDataFrame([("Other",), ("TCP",), (None,)], "protocol string")
    assert frame.filter(filters.protocol_matches("Other")).count() == 2


def test_protocol_names(spark):
    frame = spark.createDataFrame([(6,), (3,), (200,), (2054,), (145,), (0,)], "ip_proto int")
    rows = {r.ip_proto: r for r in lookups.with_protocol_name(frame).collect()}
    assert rows[6].protocol_name == "TCP"
    assert rows[6].protocol_description == "TCP (Transmission Control Protocol) - RFC 793"
    assert rows[3].protocol_short == "GGP"
    assert rows[200].protocol_name == "Unknown Protocol (200)"
    assert rows[2054].protocol_name == "ARP"
    assert lookups.protocol_dimension(spark).count() == 147


def test_info_text_is_empty_without_addresses(spark, packets):
    gone = packets.limit(1).withColumns(
        {"protocol": F.lit("TCP"), "src_ip": F.lit(None).cast("string")}
    )
    assert gone.select(info_text()).first()[0] == ""


def test_findings_default_to_none(spark, packets):
    assert rules.with_findings(packets).filter("findings IS NULL OR findings = ''").count() == 0


def test_detail_rows_keep_missing_values(packets):
    rows = detail_rows(packets.filter("protocol = 'ARP'")).filter("field = 'TTL'")
    assert {r.value for r in rows.select("value").distinct().collect()} == {"N/A"}
