"""Cleaning, row shaping, filters and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetscope.catalog import sql
from packetscope.catalog.registry import query
from packetscope.constants import (
    ARP_OPCODES,
    BASIC_FEATURES,
    DETAILED_FEATURES,
    DHCP_TYPES,
    PORT_SERVICES,
    PROTOCOL_DESCRIPTIONS,
    PROTOCOL_SHORT_NAMES,
    SNMP_PDUS,
)
from packetscope.functions.addresses import (
    arp_direction,
    direction,
    frame_direction,
    packet_direction,
    private_prefix,
    private_registry,
)
from packetscope.functions.flags import flag_mask, flag_names, suspicious_literal
from packetscope.functions.text import (
    blank_to_null,
    domain,
    epoch_seconds,
    hex_text,
    readable_seconds,
    safe_decode,
    to_int,
    to_number,
)
from packetscope.operators import filters, lookups
from packetscope.operators.features import (
    LABEL,
    basic_features,
    detailed_features,
    ensure_columns,
    features_in_order,
)
from packetscope.operators.rules import direction_meaning, protocol_tag
from packetscope.operators.shaping import (
    VIEW_COLUMNS,
    detail_rows,
    fill_by_type,
    info_text,
    number_packets,
    packet_view,
    raw_dump,
    raw_line,
    ts_text,
)
from packetscope.operators.stats import counts_or_missing
from packetscope.sources.layouts import normalise_union, to_layout

_SEC = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


@query(
    "null_sentinels",
    """
SELECT packet_id, CASE WHEN src_port_raw IN ('', 'N/A', 'None') THEN NULL ELSE src_port_raw END AS src_port_text
FROM packets""",
)
def null_sentinels(packets):
    return packets.select("packet_id", blank_to_null(F.col("src_port_raw")).alias("src_port_text"))


@query(
    "to_numeric",
    """
SELECT packet_id, coalesce(try_cast(src_port_raw AS DOUBLE), 0) AS src_port_number,
 CAST(try_cast(src_port_raw AS DOUBLE) AS INT) AS src_port_int FROM packets""",
)
def to_numeric(packets):
    raw = F.col("src_port_raw")
    return packets.select(
        "packet_id", to_number(raw).alias("src_port_number"), to_int(raw).alias("src_port_int")
    )


@query(
    "fill_by_type",
    """
SELECT packet_id, protocol, coalesce(src_port, 0) AS src_port, coalesce(ttl, 0) AS ttl,
 coalesce(dns_query, '') AS dns_query, coalesce(http_host, '') AS http_host,
 coalesce(icmp_type, 0) AS icmp_type FROM packets""",
)
def filled(packets):
    return fill_by_type(
        packets.select(
            "packet_id", "protocol", "src_port", "ttl", "dns_query", "http_host", "icmp_type"
        )
    )


@query(
    "ensure_cols",
    f""", {sql.BASIC}
SELECT packet_id, protocol_str, is_tcp, ttl,
 {', '.join(f'0 AS {c}' for c in BASIC_FEATURES if c not in ('protocol_str', 'is_tcp', 'ttl'))}
FROM basic""",
)
def ensure_cols(packets):
    partial = basic_features(packets).select("packet_id", "protocol_str", "is_tcp", "ttl")
    return ensure_columns(partial, BASIC_FEATURES)


@query(
    "feature_project",
    f""", {sql.DETAILED} SELECT {', '.join(DETAILED_FEATURES)} FROM detailed""",
)
def feature_project(packets):
    return features_in_order(detailed_features(packets), DETAILED_FEATURES)


@query(
    "packet_no",
    """
SELECT packet_id, ts, row_number() OVER (ORDER BY ts, packet_id) AS packet_no FROM packets""",
)
def packet_no(packets):
    return number_packets(packets.select("packet_id", "ts"))


_INFO = """CASE WHEN protocol IN ('TCP', 'UDP') THEN src_ip || ':' || coalesce(CAST(src_port AS VARCHAR), '')
  || ' → ' || dst_ip || ':' || coalesce(CAST(dst_port AS VARCHAR), '')
 WHEN protocol = 'ICMP' THEN 'ICMP ' || src_ip || ' → ' || dst_ip
 WHEN protocol = 'ARP' THEN 'Who has ' || dst_ip || '? Tell ' || src_ip
 WHEN protocol = 'DNS' THEN CASE WHEN dns_query <> '' THEN 'Query: ' || dns_query ELSE '' END
 WHEN protocol = 'HTTP' THEN CASE WHEN http_method <> '' AND http_path <> '' THEN http_method || ' ' || http_path
  || CASE WHEN http_host <> '' THEN ' Host: ' || http_host ELSE '' END ELSE '' END
 ELSE src_ip || ' → ' || dst_ip END"""


@query("info_text", f" SELECT packet_id, {_INFO} AS info FROM packets")
def info(packets):
    return packets.select("packet_id", info_text().alias("info"))


@query(
    "raw_line",
    f"""
SELECT packet_id, CAST(packet_id AS VARCHAR) || ': ' || concat_ws(', ', {_SEC}, src_mac, dst_mac, src_ip,
  dst_ip, protocol, CAST(length AS VARCHAR), CAST(src_port AS VARCHAR), CAST(dst_port AS VARCHAR)) AS live_line,
 CAST(packet_id AS VARCHAR) || ': ' || {_SEC} || ', ' || src_mac || ', ' || dst_mac || ', ' || src_ip || ', '
  || dst_ip || ', ' || protocol || ', ' || CAST(length AS VARCHAR) || ', '
  || coalesce(CAST(src_port AS VARCHAR), '') || ', ' || coalesce(CAST(dst_port AS VARCHAR), '') AS loaded_line
FROM packets""",
)
def raw_lines(packets):
    return packets.select(
        "packet_id", raw_line(True).alias("live_line"), raw_line(False).alias("loaded_line")
    )


_VIEW = ["protocol", "src_ip", "dst_ip", "src_port", "dst_port", "length", "info"]


@query(
    "raw_dump",
    f"""
SELECT -1::BIGINT AS line_no, '# packet_id, {', '.join(_VIEW)}' AS line
UNION ALL SELECT packet_id, CAST(packet_id AS VARCHAR) || ', ' || protocol || ', ' || src_ip || ', ' || dst_ip
 || ', ' || coalesce(CAST(src_port AS VARCHAR), '') || ', ' || coalesce(CAST(dst_port AS VARCHAR), '')
 || ', ' || CAST(length AS VARCHAR) || ', ' || {_INFO} FROM packets""",
)
def dump(packets):
    return raw_dump(packet_view(packets).select("packet_id", *_VIEW))


@query(
    "normalise_union",
    f"""
SELECT 'basic' AS layout, date_trunc('second', ts)::TIMESTAMP AS ts, src_ip, dst_ip, src_port, dst_port, protocol, length, ttl,
 tcp_flags_mask, {sql.packet_direction()} AS packet_direction, NULL::INT AS http_status, NULL::INT AS dns_qtype FROM packets
UNION ALL SELECT 'detailed', date_trunc('second', ts), src_ip, dst_ip, src_port, dst_port, protocol, length, ttl,
 CASE WHEN tcp_flags_mask <> 0 THEN tcp_flags_mask END, NULL, http_status, dns_qtype FROM packets
UNION ALL SELECT 'raw', date_trunc('millisecond', ts), src_ip, dst_ip, src_port, dst_port, protocol, length, ttl,
 CASE WHEN tcp_flags_mask <> 0 THEN tcp_flags_mask END,
 CASE WHEN protocol = 'ARP' THEN CASE arp_opcode WHEN 'request' THEN 'Request' ELSE 'Reply' END
  ELSE {sql.direction()} END, NULL, NULL FROM packets""",
)
def union_of_layouts(packets):
    parts = {name: to_layout(packets, name) for name in ("basic", "detailed", "raw")}
    return normalise_union(parts).select(
        "layout", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "length", "ttl",
        "tcp_flags_mask", "packet_direction", "http_status", "dns_qtype",
    )


@query(
    "proto_missing",
    """
SELECT 'protocol' AS section, 'N/A' AS key, count(*) AS n FROM packets
UNION ALL (SELECT 'source', src_ip, count(*) AS n FROM packets GROUP BY src_ip ORDER BY n DESC, src_ip LIMIT 10)
UNION ALL SELECT 'destination', 'N/A', count(*) FROM packets""",
)
def proto_missing(packets):
    """A capture that has neither a protocol nor a destination column."""
    partial = packets.select("src_ip")
    return counts_or_missing(
        partial, {"protocol": "protocol", "source": "src_ip", "destination": "dst_ip"}
    )


# --- filters -----------------------------------------------------------------------

_LIST = "packet_id, protocol, src_ip, dst_ip, src_port, dst_port"
_COLUMNS = _LIST.split(", ")


@query("flt_proto", f" SELECT {_LIST} FROM packets WHERE upper(protocol) = 'DNS'")
def flt_proto(packets):
    return packets.select(*_COLUMNS).filter(filters.protocol_matches("dns"))


@query(
    "flt_other",
    f" SELECT {_LIST} FROM packets WHERE upper(protocol) NOT IN ('TCP', 'UDP', 'ICMP', 'ARP')",
)
def flt_other(packets):
    return packets.select(*_COLUMNS).filter(filters.protocol_matches("Other"))


@query(
    "flt_ip",
    f" SELECT {_LIST} FROM packets WHERE strpos(src_ip, '10.0.1') > 0 OR strpos(dst_ip, '10.0.1') > 0",
)
def flt_ip(packets):
    return packets.select(*_COLUMNS).filter(filters.either_contains("src_ip", "dst_ip", "10.0.1"))


@query(
    "flt_port",
    f""" SELECT {_LIST} FROM packets WHERE CAST(src_port AS VARCHAR) LIKE '%80%'
 OR CAST(dst_port AS VARCHAR) LIKE '%80%'""",
)
def flt_port(packets):
    return packets.select(*_COLUMNS).filter(filters.either_contains("src_port", "dst_port", "80"))


@query(
    "flt_combined",
    """ SELECT count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes FROM packets WHERE upper(protocol) = 'TCP'
 AND (strpos(src_ip, '93.184') > 0 OR strpos(dst_ip, '93.184') > 0)
 AND (CAST(src_port AS VARCHAR) LIKE '%22%' OR CAST(dst_port AS VARCHAR) LIKE '%22%')""",
)
def flt_combined(packets):
    kept = filters.filter_packets(packets, protocol="tcp", ip=" 93.184 ", port="22")
    return kept.agg(
        F.count("*").alias("n"), F.sum(F.col("length").cast("bigint")).alias("bytes")
    )


@query(
    "http_rows",
    " SELECT packet_id, http_method, http_host, http_path FROM packets WHERE protocol = 'HTTP'",
)
def http_rows(packets):
    return filters.http_rows(packets).select("packet_id", "http_method", "http_host", "http_path")


@query("by_id", f" SELECT {_LIST} FROM packets WHERE packet_id = 4711")
def by_id(packets):
    return filters.packet_by_id(packets, 4711).select(*_COLUMNS)


@query("flt_clear", f" SELECT {_LIST} FROM packets")
def flt_clear(packets):
    """Cleared filters: every packet."""
    return filters.filter_packets(packets, protocol="All", ip=" ", port="").select(*_COLUMNS)


_SPARSE = ["dns_query", "http_method", "icmp_type", "arp_opcode", "dhcp_type_code", "snmp_pdu_code",
           "tls_version"]


@query("drop_blank", f" SELECT packet_id, {', '.join(_SPARSE)} FROM packets")
def without_blank(packets):
    """Every packet stays; rows without a value in any column, one beside each packet, go."""
    rows = packets.select("packet_id", *_SPARSE)
    kinds = dict(rows.dtypes)
    blank = [
        F.lit("" if kind == "string" and i % 2 else None).cast(kind).alias(name)
        for i, (name, kind) in enumerate(kinds.items())
    ]
    return filters.drop_blank(rows.unionByName(rows.select(*blank)))


@query("first_n", f" SELECT ts, {_LIST} FROM packets ORDER BY ts, packet_id LIMIT 500")
def first_n(packets):
    return filters.first_packets(packets.select("ts", *_COLUMNS), 500)


@query(
    "first_t",
    f""" SELECT ts, {_LIST} FROM packets
 WHERE ts < (SELECT min(ts) FROM packets) + INTERVAL 6 HOUR""",
)
def first_t(packets):
    return filters.first_seconds(packets.select("ts", *_COLUMNS), 6 * 3600)


@query(
    "first_1000",
    f"""
SELECT packet_id, CAST(packet_id AS VARCHAR) || ': ' || {_SEC} || ', ' || src_mac || ', ' || dst_mac || ', '
  || src_ip || ', ' || dst_ip || ', ' || protocol || ', ' || CAST(length AS VARCHAR) || ', '
  || coalesce(CAST(src_port AS VARCHAR), '') || ', ' || coalesce(CAST(dst_port AS VARCHAR), '') AS line
FROM packets ORDER BY packet_id LIMIT 1000""",
)
def first_1000(packets):
    """The raw view shows the first thousand packets."""
    return filters.first_by_id(packets, n=1000).select("packet_id", raw_line(False).alias("line"))


@query("last_100", " SELECT packet_id FROM packets ORDER BY packet_id DESC LIMIT 100")
def last_100(packets):
    return filters.last_packets(packets.select("packet_id"), 100)


# --- lookups -------------------------------------------------------------------------

_PROTO = f""", {sql.values(PROTOCOL_DESCRIPTIONS, 'num, description', 'long_names')},
{sql.values(PROTOCOL_SHORT_NAMES, 'num, short_name', 'short_names')},
named AS (SELECT p.packet_id, p.ip_proto,
 coalesce(s.short_name, l.description, 'Unknown Protocol (' || p.ip_proto || ')') AS protocol_name,
 coalesce(l.description, 'Unknown Protocol (' || p.ip_proto || ')') AS protocol_description
 FROM packets p LEFT JOIN long_names l ON p.ip_proto = l.num LEFT JOIN short_names s ON p.ip_proto = s.num)
"""


@query("proto_name", _PROTO + "SELECT packet_id, ip_proto, protocol_name, protocol_description FROM named")
def proto_name(packets):
    named = lookups.with_protocol_name(packets.select("packet_id", "ip_proto"))
    return named.drop("protocol_short")


@query("proto_short", _PROTO + "SELECT packet_id, split_part(protocol_name, ' ', 1) AS protocol_short FROM named")
def proto_short(packets):
    named = lookups.with_protocol_name(packets.select("packet_id", "ip_proto"))
    return named.select("packet_id", "protocol_short")


@query(
    "proto_fallback",
    """ SELECT packet_id, CASE ip_proto WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP'
 ELSE CAST(ip_proto AS VARCHAR) END AS protocol_label FROM packets""",
)
def proto_fallback(packets):
    return packets.select(
        "packet_id", lookups.protocol_fallback(F.col("ip_proto")).alias("protocol_label")
    )


@query(
    "port_service",
    f""", {sql.values(PORT_SERVICES, 'port, service', 'services')}
SELECT packet_id, src_port, dst_port, a.service AS src_service, b.service AS dst_service
FROM packets LEFT JOIN services a ON src_port = a.port LEFT JOIN services b ON dst_port = b.port""",
)
def port_service(packets):
    return lookups.with_port_services(packets.select("packet_id", "src_port", "dst_port"))


@query(
    "dhcp_name",
    f""", {sql.values(DHCP_TYPES, 'code, name', 'names')}
SELECT packet_id, dhcp_type_code, coalesce(name, CAST(dhcp_type_code AS VARCHAR)) AS dhcp_type
FROM packets LEFT JOIN names ON dhcp_type_code = code""",
)
def dhcp_name(packets):
    return lookups.with_dhcp_name(packets.select("packet_id", "dhcp_type_code"))


@query(
    "snmp_name",
    f""", {sql.values(SNMP_PDUS, 'code, name', 'names')}
SELECT packet_id, snmp_pdu_code, coalesce(name, CAST(snmp_pdu_code AS VARCHAR)) AS snmp_pdu
FROM packets LEFT JOIN names ON snmp_pdu_code = code""",
)
def snmp_name(packets):
    return lookups.with_snmp_name(packets.select("packet_id", "snmp_pdu_code"))


@query(
    "arp_name",
    f""", {sql.values(ARP_OPCODES, 'code, name', 'names')},
ops AS (SELECT packet_id, CASE WHEN protocol = 'ARP' THEN CAST(1 + packet_id % 4 AS INT) END AS arp_op FROM packets)
SELECT packet_id, arp_op, coalesce(name, CAST(arp_op AS VARCHAR)) AS arp_opcode
FROM ops LEFT JOIN names ON arp_op = code""",
)
def arp_name(packets):
    op = F.when(F.col("protocol") == "ARP", (1 + F.col("packet_id") % 4).cast("int"))
    return lookups.with_arp_name(packets.select("packet_id", op.alias("arp_op")))


@query(
    "proto_by_port",
    f"""
SELECT packet_id, CASE ({sql.TRANSPORT}) WHEN 'TCP' THEN
  CASE WHEN src_port IN (443, 8443) OR dst_port IN (443, 8443) THEN 'TLS'
       WHEN src_port IN (80, 8080) OR dst_port IN (80, 8080) THEN 'HTTP' ELSE 'TCP' END
 WHEN 'UDP' THEN CASE WHEN 53 IN (src_port, dst_port) THEN 'DNS'
       WHEN src_port IN (67, 68) OR dst_port IN (67, 68) THEN 'DHCP'
       WHEN src_port IN (161, 162) OR dst_port IN (161, 162) THEN 'SNMP' ELSE 'UDP' END
 ELSE ({sql.TRANSPORT}) END AS by_port FROM packets""",
)
def proto_by_port(packets):
    transport = lookups.transport_of(F.col("protocol"))
    return packets.select(
        "packet_id",
        lookups.protocol_by_port(transport, F.col("src_port"), F.col("dst_port")).alias("by_port"),
    )


# --- scalar functions -----------------------------------------------------------------


@query(
    "tcp_flag_names",
    f"""
SELECT packet_id, {sql.flag_names('tcp_flags_mask')} AS spaced, {sql.flag_names('tcp_flags_mask', '+')} AS plussed,
 tcp_flags_mask AS back FROM packets""",
)
def tcp_flag_names(packets):
    mask = F.col("tcp_flags_mask")
    named = packets.select(
        "packet_id", flag_names(mask).alias("spaced"), flag_names(mask, "+").alias("plussed")
    )
    return named.withColumn("back", flag_mask(F.col("plussed")))


@query(
    "flag_literal",
    f""", n AS (SELECT packet_id, {sql.flag_names('tcp_flags_mask', '+')} AS plussed,
 {sql.flag_names('tcp_flags_mask')} AS spaced FROM packets)
SELECT packet_id, CASE WHEN plussed LIKE '%RST+ACK%' OR plussed LIKE '%FIN+RST%' OR plussed LIKE '%SYN+FIN%'
 THEN 1 ELSE 0 END AS in_plussed, CASE WHEN spaced LIKE '%RST+ACK%' THEN 1 ELSE 0 END AS in_spaced FROM n""",
)
def flag_literal(packets):
    mask = F.col("tcp_flags_mask")
    return packets.select(
        "packet_id",
        suspicious_literal(flag_names(mask, "+")).alias("in_plussed"),
        suspicious_literal(flag_names(mask)).alias("in_spaced"),
    )


@query("dns_domain", " SELECT packet_id, lower(coalesce(dns_query, '')) AS domain FROM packets")
def dns_domain(packets):
    return packets.select("packet_id", domain(F.col("dns_query")).alias("domain"))


@query(
    "ip_private_reg",
    f""" SELECT packet_id, src_ip, {sql.private_registry('src_ip')} AS src_private,
 {sql.private_registry('dst_ip')} AS dst_private FROM packets""",
)
def ip_private_reg(packets):
    return packets.select(
        "packet_id",
        "src_ip",
        private_registry(F.col("src_ip")).alias("src_private"),
        private_registry(F.col("dst_ip")).alias("dst_private"),
    )


@query(
    "ip_private_prefix",
    f""" SELECT packet_id, src_ip, {sql.private_prefix('src_ip')} AS src_private,
 {sql.private_prefix('dst_ip')} AS dst_private FROM packets""",
)
def ip_private_prefix(packets):
    return packets.select(
        "packet_id",
        "src_ip",
        private_prefix(F.col("src_ip")).alias("src_private"),
        private_prefix(F.col("dst_ip")).alias("dst_private"),
    )


@query(
    "direction",
    f""", d AS (SELECT packet_id, {sql.direction()} AS direction FROM packets)
SELECT packet_id, direction, CASE direction WHEN 'Inbound' THEN 'incoming' WHEN 'Outbound' THEN 'outgoing'
 ELSE 'other' END AS meaning FROM d""",
)
def directions(packets):
    way = direction(F.col("src_ip"), F.col("dst_ip"))
    return packets.select("packet_id", way.alias("direction")).withColumn(
        "meaning", direction_meaning(F.col("direction"))
    )


@query(
    "direction_l2",
    f"""
SELECT packet_id, CASE WHEN dst_ip = '255.255.255.255' THEN 'Broadcast' ELSE 'Local' END AS arp_way,
 {sql.packet_direction()} AS packet_way,
 CASE WHEN protocol = 'ARP' THEN CASE arp_opcode WHEN 'request' THEN 'Request' WHEN 'reply' THEN 'Reply'
   ELSE 'Unknown' END ELSE {sql.direction()} END AS frame_way,
 CASE WHEN dst_mac LIKE 'ff:ff:ff%' THEN 'Broadcast' ELSE 'Unknown' END AS bare_way FROM packets""",
)
def direction_l2(packets):
    c = F.col
    nothing = F.lit(None).cast("string")
    return packets.select(
        "packet_id",
        arp_direction(c("dst_ip")).alias("arp_way"),
        packet_direction(c("protocol"), c("src_ip"), c("dst_ip")).alias("packet_way"),
        frame_direction(
            c("protocol"), c("arp_opcode"), c("src_ip"), c("dst_ip"), c("dst_mac")
        ).alias("frame_way"),
        # a frame of unknown kind has no addresses but the hardware ones
        frame_direction(F.lit("Unknown"), nothing, nothing, nothing, c("dst_mac")).alias("bare_way"),
    )


@query(
    "proto_tag",
    """
SELECT packet_id, protocol, CASE WHEN strpos(upper(protocol), 'TCP') > 0 THEN 'tcp'
 WHEN strpos(upper(protocol), 'UDP') > 0 THEN 'udp' WHEN strpos(upper(protocol), 'ICMP') > 0 THEN 'icmp'
 WHEN strpos(upper(protocol), 'ARP') > 0 THEN 'arp' WHEN strpos(upper(protocol), 'DNS') > 0 THEN 'dns'
 WHEN strpos(upper(protocol), 'HTTP') > 0 THEN 'http' WHEN upper(protocol) LIKE '%TLS%' THEN 'tls'
 WHEN upper(protocol) LIKE '%SSL%' THEN 'tls' ELSE 'other' END AS tag FROM packets""",
)
def proto_tag(packets):
    return packets.select("packet_id", "protocol", protocol_tag(F.col("protocol")).alias("tag"))


@query(
    "format_time",
    """, e AS (SELECT packet_id, epoch(ts) - (SELECT min(epoch(ts)) FROM packets) AS s FROM packets)
SELECT packet_id, CASE WHEN s < 60 THEN printf('%.1f seconds', s)
 WHEN s < 3600 THEN printf('%d minutes %d seconds', CAST(floor(s / 60) AS BIGINT), CAST(floor(s) AS BIGINT) % 60)
 ELSE printf('%d hours %d minutes', CAST(floor(s / 3600) AS BIGINT), (CAST(floor(s) AS BIGINT) % 3600) // 60)
 END AS since_start FROM e""",
)
def format_time(packets):
    """Time since the first packet, in words."""
    start = packets.agg(F.min("ts").alias("t")).select(epoch_seconds(F.col("t"))).scalar()
    seconds = epoch_seconds(F.col("ts")) - start
    return packets.select("packet_id", readable_seconds(seconds).alias("since_start"))


@query(
    "ts_text",
    f""" SELECT packet_id, {_SEC} AS to_second, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS to_milli FROM packets""",
)
def ts_texts(packets):
    ts = F.col("ts")
    return packets.select(
        "packet_id", ts_text(ts).alias("to_second"), ts_text(ts, millis=True).alias("to_milli")
    )


@query(
    "hex_text",
    """ SELECT packet_id, CASE WHEN tcp_window <> 0 THEN '0x' || lower(printf('%x', tcp_window)) ELSE '' END
 AS window_hex FROM packets""",
)
def hex_texts(packets):
    return packets.select("packet_id", hex_text(F.col("tcp_window")).alias("window_hex"))


@query(
    "safe_decode",
    """ SELECT packet_id, coalesce(http_host, protocol) || coalesce(http_path, '') AS decoded FROM packets""",
)
def safe_decoded(packets):
    """Text with a stray byte and a cut-off sequence in it comes back without them."""
    text = F.coalesce("http_host", "protocol")
    raw = F.concat(
        F.encode(text, "UTF-8"),
        F.unhex(F.lit("FF")),
        F.encode(F.coalesce("http_path", F.lit("")), "UTF-8"),
        F.unhex(F.lit("E282")),
    )
    return packets.select("packet_id", safe_decode(raw).alias("decoded"))


# --- feature tables --------------------------------------------------------------------


@query(
    "feat_basic",
    f", {sql.BASIC} SELECT packet_id, {', '.join(BASIC_FEATURES)}, is_threat FROM basic",
)
def feat_basic(packets):
    return basic_features(packets)


@query(
    "feat_detailed",
    f", {sql.DETAILED} SELECT packet_id, {', '.join(DETAILED_FEATURES)}, is_threat FROM detailed",
)
def feat_detailed(packets):
    return detailed_features(packets)


@query("label_basic", f", {sql.BASIC} SELECT packet_id, is_threat FROM basic")
def label_basic(packets):
    return basic_features(packets).select("packet_id", LABEL)


@query("label_detailed", f", {sql.DETAILED} SELECT packet_id, is_threat FROM detailed")
def label_detailed(packets):
    return detailed_features(packets).select("packet_id", LABEL)


_NA = "coalesce(CAST({} AS VARCHAR), 'N/A')"


def _detail(layer: str, field: str, value: str, where: str = "TRUE") -> str:
    return f"SELECT packet_id, '{layer}' AS layer, '{field}' AS field, {value} AS value FROM packets WHERE {where}"


@query(
    "detail_rows",
    "\n"
    + "\nUNION ALL ".join(
        [
            _detail("frame", "Packet ID", _NA.format("packet_id")),
            _detail("frame", "Timestamp", _SEC),
            _detail("frame", "Protocol", "upper(protocol)"),
            _detail("frame", "Length", _NA.format("length")),
            _detail("ethernet", "Source MAC", "src_mac"),
            _detail("ethernet", "Destination MAC", "dst_mac"),
            _detail("network", "Source IP", "src_ip"),
            _detail("network", "Destination IP", "dst_ip"),
            _detail("network", "TTL", _NA.format("ttl")),
            _detail("transport", "Source Port", _NA.format("src_port"), "protocol IN ('TCP', 'UDP')"),
            _detail("transport", "Destination Port", _NA.format("dst_port"), "protocol IN ('TCP', 'UDP')"),
            _detail("transport", "TCP Flags", sql.flag_names("tcp_flags_mask"), "protocol = 'TCP'"),
            _detail("transport", "Window Size", _NA.format("tcp_window"), "protocol = 'TCP'"),
            _detail("transport", "UDP Length", _NA.format("udp_length"), "protocol = 'UDP'"),
            _detail("transport", "ICMP Type", _NA.format("icmp_type"), "protocol = 'ICMP'"),
            _detail("transport", "ICMP Code", _NA.format("icmp_code"), "protocol = 'ICMP'"),
            _detail("application", "HTTP Method", _NA.format("http_method"), "protocol = 'HTTP'"),
            _detail("application", "HTTP Host", _NA.format("http_host"), "protocol = 'HTTP'"),
            _detail("application", "HTTP Path", _NA.format("http_path"), "protocol = 'HTTP'"),
            _detail("application", "DNS Query", _NA.format("dns_query"), "protocol = 'DNS'"),
            _detail("application", "DNS Query Type", _NA.format("dns_qtype"), "protocol = 'DNS'"),
        ]
    ),
)
def details(packets):
    return detail_rows(packets)


@query(
    "packet_list",
    f"""
SELECT packet_id, {_SEC} AS timestamp, src_mac, dst_mac, src_ip, dst_ip, src_port, dst_port, protocol, length, ttl,
 {sql.flag_names('tcp_flags_mask')} AS tcp_flags, tcp_window, icmp_type, icmp_code, dns_query, http_method,
 http_host, http_path, {sql.packet_direction()} AS packet_direction, {_INFO} AS info FROM packets""",
)
def packet_list(packets):
    return packet_view(packets).select(*VIEW_COLUMNS)
