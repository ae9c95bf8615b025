"""Frame encoding, decoding and byte views.

Frames are encoded from the packets relation, so every decoder can be checked
against the packets' own fields.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from packetscope.catalog import sql
from packetscope.catalog.registry import query
from packetscope.constants import DHCP_TYPES, EICAR_MARKER, SNMP_PDUS
from packetscope.operators import decode, encode
from packetscope.operators.rules import with_frame_signatures

_NUMBER = f"CASE ({sql.TRANSPORT}) WHEN 'TCP' THEN 6 WHEN 'UDP' THEN 17 ELSE 1 END"
_IS_IP = "protocol <> 'ARP'"
_IS_TCP = f"({sql.TRANSPORT}) = 'TCP'"
_IS_UDP = f"({sql.TRANSPORT}) = 'UDP'"


@query("frame_encode", f", {sql.FRAMES} SELECT packet_id, ts, frame_hex FROM frames")
def frame_encode(packets):
    return encode.frames(packets).select("packet_id", "ts", F.hex("frame").alias("frame_hex"))


@query(
    "frame_eth",
    """ SELECT packet_id, src_mac, dst_mac, CASE WHEN protocol = 'ARP' THEN 2054 ELSE 2048 END AS ethertype
FROM packets""",
)
def frame_eth(packets):
    return decode.ethernet(encode.frames(packets)).select("packet_id", "src_mac", "dst_mac", "ethertype")


@query(
    "frame_ipv4",
    f""", {sql.FRAMES} SELECT packet_id, 4 AS ip_version, 5 AS ip_ihl, 0 AS ip_dscp_ecn,
 CAST(20 + length(body_hex) // 2 AS INT) AS ip_total_length, CAST(packet_id % 65536 AS INT) AS ip_id, 2 AS ip_flags,
 0 AS ip_fragment_offset, 0 AS ip_fragment_bytes, ttl, {_NUMBER} AS ip_proto, 0 AS ip_checksum, src_ip, dst_ip
FROM frames WHERE {_IS_IP}""",
)
def frame_ipv4(packets):
    return decode.ipv4(encode.frames(packets)).select(
        "packet_id", "ip_version", "ip_ihl", "ip_dscp_ecn", "ip_total_length", "ip_id", "ip_flags",
        "ip_fragment_offset", "ip_fragment_bytes", "ttl", "ip_proto", "ip_checksum", "src_ip", "dst_ip",
    )


# Packets of the test relation between IPv6 addresses, in the shortest form of their text.
_V6 = """v6 AS (SELECT packet_id, ts, src_mac, dst_mac, protocol, transport, src_port, dst_port, ttl, payload_hex,
 body_hex, length(body_hex) // 2 AS size, 1 + user_id % 4095 AS s, 1 + packet_id % 4095 AS d,
 CASE transport WHEN 'TCP' THEN 6 WHEN 'UDP' THEN 17 ELSE 58 END AS number,
 '2001:db8::' || printf('%x', 1 + user_id % 4095) AS src, 'fe80::1:0:0:' || printf('%x', 1 + packet_id % 4095) AS dst
 FROM bodies WHERE protocol <> 'ARP'),
sums AS (SELECT *, size + number + 8193 + 3512 + s + 65152 + 1 + d + CAST(coalesce(list_sum(list_transform(
  range(0, (size + 1) // 2), lambda i: CAST('0x' || rpad(substr(body_hex, i * 4 + 1, 4), 4, '0') AS BIGINT))), 0)
  AS BIGINT) AS w FROM v6),
folded AS (SELECT *, (w & 65535) + (w >> 16) AS once FROM sums),
checked AS (SELECT *, (once & 65535) + (once >> 16) AS twice FROM folded)"""


def in_ipv6(packets):
    """IP packets of the relation, moved to IPv6 addresses."""

    def digits(column: str):
        return F.lower(F.hex(1 + F.col(column) % 4095))

    return packets.filter("protocol <> 'ARP'").withColumns(
        {
            "src_ip": F.concat(F.lit("2001:db8::"), digits("user_id")),
            "dst_ip": F.concat(F.lit("fe80::1:0:0:"), digits("packet_id")),
        }
    )


@query(
    "frame_ipv6",
    f""", {sql.FRAMES}, {_V6} SELECT packet_id, 6 AS ip_version, 0 AS ip_dscp_ecn, 0 AS ip6_flow_label,
 CAST(size AS INT) AS ip6_payload_length, number AS ip6_next_header, ttl, src AS src_ip, dst AS dst_ip,
 CASE WHEN transport IN ('TCP', 'UDP') THEN src_port END AS src_port,
 CASE WHEN transport IN ('TCP', 'UDP') THEN dst_port END AS dst_port,
 CASE WHEN transport IN ('TCP', 'UDP') THEN CAST(CASE WHEN twice = 65535 THEN 65535 ELSE 65535 - twice END AS INT)
 END AS checksum FROM checked""",
)
def frame_ipv6(packets):
    """IPv6 headers, and the transport checksum that covers their addresses."""
    headers = decode.frame_headers(encode.frames(in_ipv6(packets)))
    return headers.filter("ip_version = 6").select(
        "packet_id", "ip_version", "ip_dscp_ecn", "ip6_flow_label", "ip6_payload_length",
        "ip6_next_header", "ttl", "src_ip", "dst_ip",
        F.coalesce("tcp_src_port", "udp_src_port").alias("src_port"),
        F.coalesce("tcp_dst_port", "udp_dst_port").alias("dst_port"),
        F.coalesce("tcp_checksum", "udp_checksum_value").alias("checksum"),
    )


def tagged(frames):
    """None, one or two VLAN tags, by packet id; the outer of two is a service tag."""
    number = F.col("packet_id")
    inner = encode.with_vlan_tag(frames, F.lit(0x8100), number % 4095, number % 3 > 0)
    return encode.with_vlan_tag(inner, F.lit(0x88A8), number % 91, number % 3 == 2)


_TAGS = """CAST(packet_id % 3 AS INT) AS vlan_depth,
 CAST(CASE packet_id % 3 WHEN 1 THEN packet_id % 4095 WHEN 2 THEN packet_id % 91 END AS INT) AS vlan_outer,
 CAST(CASE WHEN packet_id % 3 > 0 THEN packet_id % 4095 END AS INT) AS vlan_inner"""


@query(
    "frame_vlan",
    f""" SELECT packet_id, CASE packet_id % 3 WHEN 1 THEN 33024 WHEN 2 THEN 34984 ELSE
 CASE WHEN protocol = 'ARP' THEN 2054 ELSE 2048 END END AS ethertype, {_TAGS},
 CASE WHEN protocol <> 'ARP' THEN src_ip END AS src_ip, CASE WHEN protocol <> 'ARP' THEN dst_ip END AS dst_ip,
 CASE WHEN ({sql.TRANSPORT}) = 'TCP' THEN src_port END AS tcp_src_port,
 CASE WHEN ({sql.TRANSPORT}) = 'UDP' THEN dst_port END AS udp_dst_port, icmp_type,
 CASE WHEN protocol = 'ARP' THEN src_ip END AS arp_src_ip FROM packets""",
)
def frame_vlan(packets):
    """Headers behind stacked VLAN tags."""
    return decode.frame_headers(tagged(encode.frames(packets))).select(
        "packet_id", "ethertype", "vlan_depth", "vlan_outer", "vlan_inner", "src_ip", "dst_ip",
        "tcp_src_port", "udp_dst_port", "icmp_type", "arp_src_ip",
    )


@query(
    "frame_tcp",
    f""" SELECT packet_id, src_port AS tcp_src_port, dst_port AS tcp_dst_port, 1::BIGINT AS tcp_seq, 1::BIGINT AS tcp_ack,
 5 AS tcp_data_offset, tcp_flags_mask, CAST(tcp_window % 65536 AS INT) AS tcp_window, 0 AS tcp_checksum,
 0 AS tcp_urgent FROM packets WHERE {_IS_TCP}""",
)
def frame_tcp(packets):
    return decode.tcp(encode.frames(packets)).select(
        "packet_id", "tcp_src_port", "tcp_dst_port", "tcp_seq", "tcp_ack", "tcp_data_offset",
        "tcp_flags_mask", "tcp_window", "tcp_checksum", "tcp_urgent",
    )


@query(
    "frame_udp",
    f""", {sql.FRAMES} SELECT packet_id, src_port AS udp_src_port, dst_port AS udp_dst_port,
 CAST(8 + length(payload_hex) // 2 AS INT) AS udp_length, 0 AS udp_checksum_value FROM frames WHERE {_IS_UDP}""",
)
def frame_udp(packets):
    return decode.udp(encode.frames(packets)).select(
        "packet_id", "udp_src_port", "udp_dst_port", "udp_length", "udp_checksum_value"
    )


@query("frame_icmp", " SELECT packet_id, icmp_type, icmp_code FROM packets WHERE protocol = 'ICMP'")
def frame_icmp(packets):
    return decode.icmp(encode.frames(packets)).select("packet_id", "icmp_type", "icmp_code")


@query(
    "frame_arp",
    """ SELECT packet_id, arp_opcode, src_mac AS arp_src_mac, src_ip AS arp_src_ip, dst_mac AS arp_dst_mac,
 dst_ip AS arp_dst_ip FROM packets WHERE protocol = 'ARP'""",
)
def frame_arp(packets):
    return decode.arp(encode.frames(packets)).select(
        "packet_id", "arp_opcode", "arp_src_mac", "arp_src_ip", "arp_dst_mac", "arp_dst_ip"
    )


@query(
    "frame_http",
    """ SELECT packet_id, http_method, http_host, http_path, CAST(NULL AS INT) AS http_status,
 CASE WHEN protocol = 'HTTP (Raw)' THEN '.. GET /part/' || packet_id END AS http_raw
FROM packets WHERE protocol IN ('HTTP', 'HTTP (Raw)')""",
)
def frame_http(packets):
    return decode.http(encode.frames(packets)).select(
        "packet_id", "http_method", "http_host", "http_path", "http_status", "http_raw"
    )


_NAMES = f"{sql.values(DHCP_TYPES, 'code, name', 'dhcp')}, {sql.values(SNMP_PDUS, 'code, name', 'snmp')}"
_APP = """CASE WHEN protocol = 'DNS' THEN CAST(packet_id % 65536 AS INT) END AS dns_id,
 CASE WHEN protocol = 'DNS' THEN 0 END AS dns_qr, CASE WHEN protocol = 'DNS' THEN 0 END AS dns_opcode,
 dns_query, dns_qtype, coalesce(dhcp.name, CAST(dhcp_type_code AS VARCHAR)) AS dhcp_type,
 CASE WHEN protocol = 'SNMP' THEN 'public' END AS snmp_community,
 coalesce(snmp.name, CAST(snmp_pdu_code AS VARCHAR)) AS snmp_pdu,
 CASE WHEN protocol = 'SNMP' THEN packet_id END AS snmp_request_id,
 CASE WHEN protocol = 'SNMP' THEN '1.3.6.1.2.1.1.1.0' END AS snmp_oid,
 CASE WHEN protocol = 'SNMP' THEN 'v' || packet_id END AS snmp_value,
 tls_content_type, tls_version, tls_handshake_type"""
_APP_COLUMNS = [
    "dns_id", "dns_qr", "dns_opcode", "dns_query", "dns_qtype", "dhcp_type", "snmp_community",
    "snmp_pdu", "snmp_request_id", "snmp_oid", "snmp_value", "tls_content_type", "tls_version",
    "tls_handshake_type",
]


@query(
    "frame_status",
    """ SELECT packet_id, CAST(NULL AS VARCHAR) AS http_method, http_status, src_port AS dst_port, dst_port AS src_port
FROM packets WHERE protocol = 'HTTP'""",
)
def frame_status(packets):
    """Status lines: each request's response, sent the other way."""
    answers = packets.filter("protocol = 'HTTP'").withColumns(
        {"http_method": F.lit(None).cast("string"), "src_port": F.col("dst_port"), "dst_port": F.col("src_port")}
    )
    return decode.http(encode.frames(answers)).select(
        "packet_id", "http_method", "http_status", F.col("tcp_dst_port").alias("dst_port"),
        F.col("tcp_src_port").alias("src_port"),
    )


@query(
    "frame_answers",
    """ SELECT packet_id, 1 AS dns_qr, dns_query, dns_qtype,
 CASE WHEN packet_id % 2 = 0 THEN dns_query ELSE 'alias.' || dns_query END AS dns_ans_name,
 CAST(CASE packet_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 28 ELSE 5 END AS INT) AS dns_ans_type,
 CASE packet_id % 3 WHEN 0 THEN '10.1.2.' || (packet_id % 250) WHEN 1
  THEN '2001:db8::' || printf('%x', 1 + packet_id % 4095) ELSE 'x.' || dns_query END AS dns_ans_rdata
FROM packets WHERE protocol = 'DNS'""",
)
def frame_answers(packets):
    """First answers of DNS responses, with and without compressed names."""
    number, name = F.col("packet_id"), F.col("dns_query")
    answers = packets.filter("protocol = 'DNS'").withColumns(
        {
            "dns_ans_name": F.when(number % 2 == 0, name).otherwise(F.concat(F.lit("alias."), name)),
            "dns_ans_type": F.when(number % 3 == 0, 1).when(number % 3 == 1, 28).otherwise(5),
            "dns_ans_rdata": F.when(number % 3 == 0, F.concat(F.lit("10.1.2."), (number % 250).cast("string")))
            .when(number % 3 == 1, F.concat(F.lit("2001:db8::"), F.lower(F.hex(1 + number % 4095))))
            .otherwise(F.concat(F.lit("x."), name)),
        }
    )
    return decode.application(encode.frames(answers)).select(
        "packet_id", "dns_qr", "dns_query", "dns_qtype", "dns_ans_name", "dns_ans_type", "dns_ans_rdata"
    )


@query(
    "frame_app",
    f""", {_NAMES} SELECT packet_id, protocol AS app_protocol, {_APP}
FROM packets LEFT JOIN dhcp ON dhcp_type_code = dhcp.code LEFT JOIN snmp ON snmp_pdu_code = snmp.code
WHERE protocol IN ('DNS', 'DHCP', 'SNMP', 'TLS')""",
)
def frame_app(packets):
    return decode.application(encode.frames(packets)).select(
        "packet_id", "app_protocol", *_APP_COLUMNS
    )


@query(
    "decode_frames",
    f""", {sql.FRAMES}, {_NAMES} SELECT packet_id, ts, src_mac, dst_mac, src_ip, dst_ip, src_port, dst_port,
 CASE WHEN protocol IN ('HTTPS', 'FTP', 'SSH', 'TELNET') THEN 'TCP' ELSE protocol END AS protocol,
 CAST(length(frame_hex) // 2 AS INT) AS length, ttl, {sql.flag_names('tcp_flags_mask')} AS tcp_flags,
 CAST(tcp_window % 65536 AS INT) AS tcp_window, icmp_type, icmp_code, http_method, http_host,
 CASE WHEN protocol = 'HTTP (Raw)' THEN '.. GET /part/' || packet_id ELSE http_path END AS http_path,
 {sql.packet_direction()} AS packet_direction, arp_opcode, {_APP}
FROM frames LEFT JOIN dhcp ON dhcp_type_code = dhcp.code LEFT JOIN snmp ON snmp_pdu_code = snmp.code""",
)
def decode_frames(packets):
    return decode.decode_frames(encode.frames(packets)).select(
        "packet_id", "ts", "src_mac", "dst_mac", "src_ip", "dst_ip", "src_port", "dst_port",
        "protocol", "length", "ttl", "tcp_flags", "tcp_window", "icmp_type", "icmp_code",
        "http_method", "http_host", "http_path", "packet_direction", "arp_opcode", *_APP_COLUMNS,
    )


@query(
    "decode_mixed",
    f""", {sql.FRAMES}, {_V6}, {_NAMES}, mixed AS (
 SELECT packet_id, ts, protocol, src_ip AS src, dst_ip AS dst, CAST(length(frame_hex) // 2 AS INT) AS size FROM frames
 WHERE packet_id % 2 = 0 OR protocol = 'ARP'
 UNION ALL SELECT packet_id, ts, CASE WHEN protocol = 'ICMP' THEN '58' ELSE protocol END, src, dst,
  CAST(54 + size AS INT) FROM v6 WHERE packet_id % 2 = 1)
SELECT packet_id, m.ts, m.src AS src_ip, m.dst AS dst_ip, p.src_port, p.dst_port, p.ttl,
 CASE WHEN m.protocol IN ('HTTPS', 'FTP', 'SSH', 'TELNET') THEN 'TCP' ELSE m.protocol END AS protocol,
 CAST(m.size + 4 * (packet_id % 3) AS INT) AS length, CASE WHEN m.protocol = 'ICMP' THEN icmp_type END AS icmp_type,
 http_method, http_host, arp_opcode, {_APP.replace("protocol =", "m.protocol =")}
FROM mixed m JOIN packets p USING (packet_id)
LEFT JOIN dhcp ON dhcp_type_code = dhcp.code LEFT JOIN snmp ON snmp_pdu_code = snmp.code""",
)
def decode_mixed(packets):
    """Whole rows of IPv4, IPv6 and ARP frames with none, one or two VLAN tags."""
    even = (F.col("packet_id") % 2 == 0) | (F.col("protocol") == "ARP")
    mixed = encode.frames(packets.filter(even)).unionByName(encode.frames(in_ipv6(packets.filter(~even))))
    return decode.decode_frames(tagged(mixed)).select(
        "packet_id", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "ttl", "protocol", "length",
        "icmp_type", "http_method", "http_host", "arp_opcode", *_APP_COLUMNS,
    )


@query(
    "hex_dump",
    f""", {sql.FRAMES}, pieces AS (SELECT packet_id, byte_offset, substr(frame_hex, byte_offset * 2 + 1, 32) AS piece
 FROM (SELECT packet_id, frame_hex, unnest(range(0, length(frame_hex) // 2, 16)) AS byte_offset FROM frames))
SELECT packet_id, CAST(byte_offset AS INT) AS byte_offset,
 rtrim(regexp_replace(lower(piece), '(..)', '\\1 ', 'g')) AS hex,
 array_to_string(list_transform(range(0, length(piece) // 2),
  lambda i: CASE WHEN CAST('0x' || substr(piece, i * 2 + 1, 2) AS INT) BETWEEN 32 AND 126
   THEN chr(CAST('0x' || substr(piece, i * 2 + 1, 2) AS INT)) ELSE '.' END), '') AS ascii
FROM pieces""",
)
def hex_dump(packets):
    return encode.hex_dump(encode.frames(packets))


@query(
    "raw_to_bytes",
    """ SELECT packet_id, CASE WHEN packet_id % 2 = 0
 THEN printf('%02X%02X%02X', packet_id % 256, length % 256, user_id % 256)
 ELSE hex(src_mac || ' ' || protocol) END AS bytes_hex FROM packets""",
)
def raw_to_bytes(packets):
    """Saved byte lists on even packets, plain text on odd ones."""
    numbers = [(F.col(c) % 256).cast("string") for c in ("packet_id", "length", "user_id")]
    listed = F.concat(F.lit("["), F.concat_ws(", ", *numbers), F.lit("]"))
    saved = F.when(F.col("packet_id") % 2 == 0, listed).otherwise(
        F.concat_ws(" ", "src_mac", "protocol")
    )
    return packets.select("packet_id", F.hex(encode.parse_raw_data(saved)).alias("bytes_hex"))


@query(
    "byte_list",
    f""", {sql.FRAMES} SELECT packet_id, '[' || array_to_string(list_transform(range(0, length(frame_hex) // 2),
 lambda i: CAST(CAST('0x' || substr(frame_hex, i * 2 + 1, 2) AS INT) AS VARCHAR)), ', ') || ']' AS raw_data FROM frames""",
)
def byte_list(packets):
    return encode.frames(packets).select(
        "packet_id", encode.byte_list_text(F.col("frame")).alias("raw_data")
    )


# Header bytes are patched by time-to-live, so the detectors have something to find.
@query(
    "sig_frames",
    f""" SELECT packet_id, {sql.one("ttl % 11 = 0")} AS bad_ip_version, {sql.one("ttl % 7 = 0")} AS all_ip_flags,
 {sql.one(f"ttl % 7 = 0 AND ({sql.TRANSPORT}) IN ('TCP', 'UDP') AND protocol <> 'DHCP'")} AS tiny_fragment,
 {sql.one(f"ttl % 5 = 0 AND ({sql.TRANSPORT}) IN ('TCP', 'UDP') AND protocol <> 'HTTP (Raw)'")} AS test_virus
FROM packets WHERE protocol <> 'ARP' UNION ALL SELECT packet_id, 0, 0, 0, 0 FROM packets WHERE protocol = 'ARP'""",
)
def sig_frames(packets):
    """Header oddities and the antivirus test marker in frames."""
    digits, ttl = F.hex("frame"), F.col("ttl")
    version = F.when(ttl % 11 == 0, F.lit("F5")).otherwise(F.lit("45"))
    fragment = F.when(ttl % 7 == 0, F.lit("E000")).otherwise(F.lit("4000"))
    marker = F.when(
        (ttl % 5 == 0) & (F.col("protocol") != "HTTP (Raw)"), F.hex(F.lit(EICAR_MARKER))
    ).otherwise(F.lit(""))
    # total length 0 lets the decoder take everything up to the end of the frame
    patched = F.concat(
        F.substring(digits, 1, 28), version, F.lit("000000"), F.substring(digits, 37, 4), fragment,
        F.substring(digits, F.lit(45), F.length(digits)), marker,
    )
    is_arp = F.col("protocol") == "ARP"
    chosen = F.when(is_arp, F.col("frame")).otherwise(F.unhex(patched))
    frames = encode.with_frame(packets, ("tcp_window",)).select("packet_id", "ts", chosen.alias("frame"))
    found = with_frame_signatures(decode.frame_headers(frames))
    return found.select("packet_id", "bad_ip_version", "all_ip_flags", "tiny_fragment", "test_virus")
