import ipaddress
import struct
from functools import reduce

from pyspark.sql import functions as F

from packetscope.catalog.frames import in_ipv6
from packetscope.operators import appdata, decode, encode
from packetscope.operators.rules import with_frame_signatures

ETH = bytes.fromhex("0200000000010200000000020800")


def ip(proto, body, options=b"", flags_offset=0x4000, length=None, version=4):
    ihl = 5 + len(options) // 4
    total = 20 + len(options) + len(body) if length is None else length
    return struct.pack(
        "!BBHHHBBH4s4s", version << 4 | ihl, 0, total, 7, flags_offset, 64, proto, 0,
        bytes([10, 0, 0, 1]), bytes([8, 8, 8, 8]),
    ) + options + body


def tcp(sport, dport, payload=b"", flags=0x18, options=b""):
    return struct.pack(
        "!HHLLBBHHH", sport, dport, 0xFFFFFFFF, 1, (5 + len(options) // 4) << 4, flags, 500, 0, 0
    ) + options + payload


def udp(sport, dport, payload):
    return struct.pack("!HHHH", sport, dport, 8 + len(payload), 0xBEEF) + payload


def rows(spark, *frames):
    data = [(i, bytearray(f)) for i, f in enumerate(frames)]
    table = spark.createDataFrame(data, "packet_id long, frame binary").withColumn(
        "ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    )
    return {r.packet_id: r for r in decode.decode_frames(table).collect()}, table


def test_decode_of_encode_is_the_packet(packets):
    back = decode.decode_frames(encode.frames(packets))
    keys = ["packet_id", "src_ip", "dst_ip", "src_port", "dst_port", "ttl", "icmp_type", "icmp_code",
            "dns_query", "dns_qtype", "http_method", "http_host", "tls_version", "tls_content_type",
            "tls_handshake_type", "arp_opcode", "src_mac", "dst_mac"]
    assert back.select(*keys).exceptAll(packets.select(*keys)).count() == 0
    assert back.count() == packets.count()


def test_options_shift_the_transport_header(spark):
    http = b"GET /x HTTP/1.1\r\nHost: a.b\r\n\r\n"
    got, _ = rows(
        spark,
        ETH + ip(6, tcp(1234, 80, http, options=b"\x01" * 12), options=b"\x01" * 40),
        ETH + ip(6, tcp(80, 1234, b"HTTP/1.1 404 Not Found\r\n\r\n")),
        ETH + ip(6, tcp(1234, 8080, b"xx POST /y\r\nmore")),
        ETH + ip(6, tcp(1234, 80, b"\x00\x01")),
    )
    assert (got[0].protocol, got[0].http_method, got[0].http_host, got[0].http_path) == ("HTTP", "GET", "a.b", "/x")
    assert (got[1].protocol, got[1].http_status) == ("HTTP", 404)
    assert (got[2].protocol, got[2].http_path) == ("HTTP (Raw)", "xx POST /y")
    assert got[3].protocol == "TCP" and got[3].tcp_flags == "PSH ACK"


def test_short_frames_give_nulls(spark):
    full = ETH + ip(6, tcp(1, 2))
    got, _ = rows(spark, *[full[:n] for n in range(len(full) + 1)])
    assert got[len(full)].src_port == 1
    assert all(got[n].src_port is None for n in range(len(full)))
    assert got[33].src_ip is None and got[34].src_ip == "10.0.0.1" and got[34].protocol == "TCP"
    assert got[5].src_mac is None and got[0].protocol == "Unknown"


def test_padding_and_zero_length(spark):
    got, table = rows(
        spark,
        ETH + ip(17, udp(9, 9, b"ab")) + b"\0" * 16,
        ETH + ip(17, udp(9, 9, b"ab"), length=0),
    )
    payloads = {r.packet_id: bytes(r.payload) for r in decode.frame_headers(table).collect()}
    assert payloads == {0: b"ab", 1: b"ab"}
    assert got[0].udp_checksum == "0xbeef" and got[0].protocol == "UDP"


def test_later_fragments_have_no_ports(spark):
    got, table = rows(
        spark, ETH + ip(6, tcp(1, 2), flags_offset=0x2001), ETH + ip(6, tcp(1, 2), flags_offset=0xE000, version=15)
    )
    assert got[0].src_port is None and got[0].protocol == "TCP"
    headers = {r.packet_id: r for r in decode.frame_headers(table).collect()}
    assert headers[0].ip_flags == 1 and headers[0].ip_fragment_bytes == 8
    found = {r.packet_id: r for r in with_frame_signatures(decode.frame_headers(table)).collect()}
    assert found[1].bad_ip_version == 1 and found[1].all_ip_flags == 1 and found[0].all_ip_flags == 0


def dns_response():
    head = struct.pack("!HHHHHH", 5, 0x8180, 1, 2, 0, 0)
    question = b"\x03www\x07example\x03com\x00" + struct.pack("!HH", 1, 1)
    answer = b"\xc0\x0c" + struct.pack("!HHIH", 1, 1, 60, 4) + bytes([93, 184, 0, 34])
    return head + question + answer * 2


def test_dns_answer_with_name_pointer(spark):
    loop = struct.pack("!HHHHHH", 5, 0, 1, 0, 0, 0) + b"\xc0\x0c\x00\x01\x00\x01"
    got, _ = rows(
        spark, ETH + ip(17, udp(53, 4000, dns_response())), ETH + ip(17, udp(4000, 53, loop)),
        ETH + ip(17, udp(4000, 53, b"\x00\x01")),
    )
    assert (got[0].dns_qr, got[0].dns_query, got[0].dns_ans_name) == (1, "www.example.com.", "www.example.com.")
    assert (got[0].dns_ans_rdata, got[0].dns_ans_type) == ("93.184.0.34", 1)
    assert got[1].protocol == "DNS" and got[1].dns_query is None
    assert got[2].protocol == "UDP"


def test_dhcp_option_walk():
    fixed = b"\x01" + b"\0" * 235 + b"\x63\x82\x53\x63"
    assert appdata.dhcp_fields(fixed + b"\x00\x0c\x02ab\x35\x01\x05\xff")["dhcp_type_code"] == 5
    assert "dhcp_type_code" not in appdata.dhcp_fields(fixed + b"\xff")
    assert "dhcp_type_code" not in appdata.dhcp_fields(fixed + b"\x35\x01")
    assert appdata.dhcp_fields(b"") == {}


def test_snmp_value_kinds():
    assert appdata._snmp_value(2, b"\xff") == "-1"
    assert appdata._snmp_value(0x41, b"\xff") == "255"
    assert appdata._snmp_value(0x40, bytes([10, 0, 0, 1])) == "10.0.0.1"
    assert appdata._snmp_value(6, b"\x2b\x06\x01") == "1.3.6.1"
    assert appdata._oid(b"\x88\x37\x03") == "2.999.3"


def test_hex_dump_rows(spark):
    table = spark.createDataFrame([(1, bytearray(b"A\x00" * 9)), (2, bytearray())], "packet_id long, frame binary")
    got = [(r.packet_id, r.byte_offset, r.hex, r.ascii) for r in encode.hex_dump(table).collect()]
    assert got == [(1, 0, " ".join(["41 00"] * 8), "A." * 8), (1, 16, "41 00", "A.")]


MACS = bytes.fromhex("020000000001020000000002")
TCP_ROW = b"\x00\x50\x04\xd2" + bytes(8) + b"\x50\x12\x01\x00" + bytes(4)


def ip6(chain, body, src="2001:db8::1", dst="fe80::2", length=None):
    """``chain``: (own header number, bytes with the next number left 0) and the last number."""
    *headers, last = chain
    numbers = [n for n, _ in headers] + [last]
    raw = b"".join(bytes([following]) + h[1:] for (_, h), following in zip(headers, numbers[1:]))
    size = len(raw) + len(body) if length is None else length
    fixed = struct.pack("!IHBB", 6 << 28 | 0x12 << 20 | 0x345, size, numbers[0], 63)
    return fixed + ipaddress.ip_address(src).packed + ipaddress.ip_address(dst).packed + raw + body


def test_ipv6_extension_chains(spark):
    eth = MACS + b"\x86\xdd"
    hop, auth = (0, bytes([0, 0]) + bytes(6)), (51, bytes([0, 4]) + bytes(22))
    route, opts = (43, bytes([0, 2]) + bytes(22)), (60, bytes([0, 1]) + bytes(14))
    first, later = (44, struct.pack("!BBHI", 0, 0, 1, 9)), (44, struct.pack("!BBHI", 0, 0, 8 * 5, 9))
    got, table = rows(
        spark,
        eth + ip6([6], TCP_ROW),
        eth + ip6([hop, opts, route, first, auth, opts, 6], TCP_ROW),
        eth + ip6([*[opts] * 40, 17], udp(53, 9, dns_response())),
        eth + ip6([hop, later, 6], TCP_ROW),
        eth + ip6([opts, 58], b"\x80\x00\x00\x00"),
        eth + ip6([hop, 59], b""),
        eth + ip6([hop, opts, 6], TCP_ROW)[:-30],
        eth + ip6([17], udp(9, 9, b"ab")) + b"\0" * 9,
        eth + ip6([17], udp(9, 9, b"ab"), length=0),
    )
    assert (got[0].protocol, got[0].src_ip, got[0].dst_ip, got[0].ttl) == ("TCP", "2001:db8::1", "fe80::2", 63)
    assert (got[0].src_port, got[0].tcp_flags_mask) == (80, 0x12)
    assert (got[1].protocol, got[1].src_port) == ("TCP", 80)
    assert (got[2].protocol, got[2].dns_ans_rdata) == ("DNS", "93.184.0.34")
    assert (got[3].protocol, got[3].src_port) == ("TCP", None)
    assert (got[4].protocol, got[4].icmp_type) == ("58", None)
    assert got[5].protocol == "59"
    assert got[6].src_port is None and got[6].src_ip == "2001:db8::1"
    heads = {r.packet_id: r for r in decode.frame_headers(table).collect()}
    assert (heads[0].ip_version, heads[0].ip_dscp_ecn, heads[0].ip6_flow_label) == (6, 0x12, 0x345)
    assert heads[1].ip6_next_header == 0 and heads[1].ip_proto == 6 and heads[1].ip_ihl is None
    assert heads[3].ip_fragment_offset == 5 and heads[3].ip_fragment_bytes == 40
    assert (heads[4].icmp6_type, heads[4].icmp6_code) == (0x80, 0)
    assert [bytes(heads[i].payload) for i in (7, 8)] == [b"ab", b"ab"]


def test_stacked_vlan_tags(spark):
    packet = ip(6, tcp(80, 1234, b"HTTP/1.1 200 OK\r\n\r\n"))
    arp = bytes.fromhex("0001080006040001" "020000000001" "0a000001" "000000000000" "0a000002")
    got, table = rows(
        spark,
        MACS + b"\x81\x00\x20\x64\x08\x00" + packet,
        MACS + b"\x88\xa8\x00\x07\x81\x00\xe0\x64\x08\x00" + packet,
        MACS + b"\x81\x00\x00\x01" * 30 + b"\x81\x00\x00\x02\x86\xdd" + ip6([6], TCP_ROW),
        MACS + b"\x81\x00\x00\x05\x08\x06" + arp,
        MACS + b"\x81\x00\x00",
        MACS + b"\x81\x00\x00\x05\x08",
    )
    assert [(got[i].protocol, got[i].http_status, got[i].src_port) for i in (0, 1)] == [("HTTP", 200, 80)] * 2
    assert (got[2].protocol, got[2].src_ip) == ("TCP", "2001:db8::1")
    assert (got[3].protocol, got[3].src_ip, got[3].arp_opcode) == ("ARP", "10.0.0.1", "request")
    assert got[4].protocol == got[5].protocol == "Unknown"
    heads = {r.packet_id: r for r in decode.frame_headers(table).collect()}
    tags = [(heads[i].ethertype, heads[i].vlan_depth, heads[i].vlan_outer, heads[i].vlan_inner) for i in range(4)]
    assert tags == [(0x8100, 1, 100, 100), (0x88A8, 2, 7, 100), (0x8100, 31, 1, 2), (0x8100, 1, 5, 5)]


def test_addresses_of_both_kinds(spark):
    texts = ["::", "::1", "1:0:0:2:0:0:0:3", "1:2:3:4:5:6:7:8", "0:1:0:1:0:1:0:1", "1:2:3:4:5:6::",
             "::ffff:10.0.0.1", "fe80::ABCD", "2001:db8:0:0:1::1"]
    bad = ["1::2::3", "1:2:3", "12345::", "g::", ":", "1:2:3:4:5:6:7:8::", "::1.2.3.256"]
    table = spark.createDataFrame([(t,) for t in texts + bad], "ip string")
    back = table.withColumn("h", encode.ip6_hex("ip")).withColumn("g", decode._ip6_groups("lower(h)"))
    got = {r.ip: (r.h, r.text) for r in back.withColumn("text", decode._ip6_text("g")).collect()}
    for text in texts:
        address = ipaddress.ip_address(text)
        assert got[text] == (address.packed.hex().upper(), str(address))
    assert all(got[text] == (None, None) for text in bad)


def internet_sum(raw):
    total = sum(struct.unpack(f"!{len(raw) // 2}H", raw))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return total


def test_ipv6_frames_carry_a_checksum(packets):
    for row in encode.frames(in_ipv6(packets)).filter("packet_id < 60").collect():
        packet = bytes(row.frame)[14:]
        size, number = struct.unpack_from("!HB", packet, 4)
        body = packet[40:]
        assert size == len(body) and packet[0] >> 4 == 6
        pseudo = packet[8:40] + struct.pack("!II", size, number)
        assert internet_sum(pseudo + body + bytes(size % 2)) == 0xFFFF


def test_values_beyond_their_field_make_no_frame(packets):
    one = packets.filter("protocol = 'DNS'").limit(1)
    label = F.concat(F.repeat(F.lit("a"), 63), F.lit(".b"))
    cases = {
        "whole": (one, True), "port": (one.withColumn("src_port", F.lit(65536)), False),
        "negative": (one.withColumn("dst_port", F.lit(-1)), False),
        "ttl": (one.withColumn("ttl", F.lit(256)), False),
        "label": (one.withColumn("dns_query", label), True),
        "long label": (one.withColumn("dns_query", F.concat(F.lit("a"), label)), False),
        "long name": (one.withColumn("dns_query", F.repeat(F.lit("abc."), 64)), False),
        "mixed": (one.withColumn("dst_ip", F.lit("::1")), False),
        "no address": (one.withColumn("dst_ip", F.lit("1::2::3")), False),
        "v6": (one.withColumns({"src_ip": F.lit("::1"), "dst_ip": F.lit("::2")}), True),
        "full counter": (one.withColumn("packet_id", F.lit(1 << 40)), True),
    }
    http = packets.filter("protocol = 'HTTP'").limit(1)
    for size, fits in ((60_000, True), (66_000, False)):
        path = F.concat(F.lit("/"), F.repeat(F.lit("x"), size))
        cases[f"path of {size}"] = (http.withColumn("http_path", path), fits)
    cases["window"] = (http.withColumn("tcp_window", F.lit(70_000)), False)
    tables = [t.withColumn("packet_id", F.col("packet_id").cast("long")).withColumn("case", F.lit(n))
              for n, (t, _) in cases.items()]
    rows = reduce(lambda x, y: x.unionByName(y), tables).cache()
    got = {r.case: r.frame is not None for r in encode.with_frame(rows).select("case", "frame").collect()}
    assert got == {name: fits for name, (_, fits) in cases.items()}
    row = encode.with_frame(rows.filter("case = 'window'"), ("tcp_window",)).first()
    assert row.tcp_window == 70_000 and bytes(row.frame)[48:50] == struct.pack("!H", 70_000 % 65536)
    rows.unpersist()


def test_long_ber_elements(spark):
    sizes = [0, 1, 127, 128, 255, 256, 65535, 65536]
    table = spark.createDataFrame([(n,) for n in sizes], "n int")
    body = F.repeat(F.lit("61"), F.col("n"))
    got = {r.n: bytes(r.e) for r in table.select("n", F.unhex(encode._tlv("04", body)).alias("e")).collect()}
    for n in sizes:
        tag, value, end = appdata._element(got[n], 0)
        assert (tag, value, end) == (4, b"a" * n, len(got[n]))


def test_tag_beyond_twelve_bits_makes_no_frame(spark):
    table = spark.createDataFrame([(i, bytearray(ETH)) for i in (0, 4095, 4096)], "packet_id long, frame binary")
    tagged = encode.with_vlan_tag(table, F.lit(0x8100), F.col("packet_id"), F.lit(True))
    got = {r.packet_id: r.frame for r in tagged.collect()}
    assert bytes(got[4095]) == ETH[:12] + b"\x81\x00\x0f\xff" + ETH[12:] and got[4096] is None
