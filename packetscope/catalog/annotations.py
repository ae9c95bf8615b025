"""Annotation and detection rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetscope.catalog import sql
from packetscope.catalog.registry import query
from packetscope.constants import PROTOCOL_FAMILIES
from packetscope.functions.addresses import direction, network_context
from packetscope.operators import filters, rules
from packetscope.operators.lookups import with_icmp_meaning, with_protocol_family

_M = "tcp_flags_mask"


@query(
    "tcp_purpose",
    f""" SELECT packet_id, CASE WHEN protocol <> 'TCP' THEN NULL WHEN {_M} & 18 = 18 THEN 'SYN_ACK' WHEN {_M} & 2 <> 0 THEN 'SYN'
 WHEN {_M} & 17 = 17 THEN 'FIN_ACK' WHEN {_M} & 1 <> 0 THEN 'FIN' WHEN {_M} & 4 <> 0 THEN 'RST'
 WHEN {_M} & 24 = 24 THEN 'PSH_ACK' WHEN {_M} & 16 <> 0 THEN 'ACK' END AS purpose FROM packets""",
)
def tcp_purpose(packets):
    purpose = rules.on_tcp(F.col("protocol"), rules.tcp_purpose(F.col(_M)))
    return packets.select("packet_id", purpose.alias("purpose"))


@query(
    "tcp_abnormal",
    f""" SELECT packet_id, {sql.one(f'{_M} & 3 = 3')} AS syn_fin, {sql.one(f'{_M} & 6 = 6')} AS syn_rst
 FROM packets WHERE protocol = 'TCP'""",
)
def tcp_abnormal(packets):
    return packets.filter(filters.protocol_matches("TCP")).select(
        "packet_id", rules.syn_fin(F.col(_M)).alias("syn_fin"), rules.syn_rst(F.col(_M)).alias("syn_rst")
    )


_CONCERN = f"""CASE WHEN upper(protocol) <> 'TCP' THEN NULL WHEN {_M} & 3 = 3 THEN 'syn_fin'
 WHEN {_M} & 6 = 6 THEN 'syn_rst' WHEN {_M} = 0 THEN 'null_scan'
 WHEN {_M} & 4 <> 0 AND ({sql.direction()}) = 'Inbound' THEN 'connection_rejected'
 WHEN {_M} & 2 <> 0 AND dst_port < 1024 THEN 'connection_request' END"""


@query("sec_flags", f" SELECT packet_id, {_CONCERN} AS concern FROM packets")
def sec_flags(packets):
    c = F.col
    concern = rules.flag_concern(
        c("protocol"), c(_M), direction(c("src_ip"), c("dst_ip")), c("dst_port")
    )
    return packets.select("packet_id", concern.alias("concern"))


_BROAD = "dst_ip = '255.255.255.255' OR dst_mac = 'ff:ff:ff:ff:ff:ff'"
_FINDINGS = f"""coalesce(nullif(concat_ws(',', CASE WHEN {_BROAD} THEN 'broadcast' END,
  CASE WHEN ({_CONCERN}) LIKE 'connection%' THEN ({_CONCERN}) END,
  CASE WHEN upper(protocol) IN ('HTTPS', 'SSH', 'SFTP') THEN 'encrypted_protocol' END,
  CASE WHEN ({_CONCERN}) = 'null_scan' THEN 'null_scan' END,
  CASE WHEN upper(protocol) IN ('HTTP', 'TELNET', 'FTP') THEN 'plaintext_protocol' END,
  CASE WHEN ({_CONCERN}) LIKE 'syn%' THEN ({_CONCERN}) END), ''), 'none')"""


@query("sec_findings", f" SELECT packet_id, {_FINDINGS} AS findings FROM packets")
def sec_findings(packets):
    return rules.with_findings(packets).select("packet_id", "findings")


@query(
    "sec_summary",
    f""", f AS (SELECT unnest(string_split({_FINDINGS}, ',')) AS finding FROM packets)
SELECT finding, count(*) AS n FROM f GROUP BY finding""",
)
def sec_summary(packets):
    return rules.finding_counts(packets)


@query(
    "net_context",
    f""" SELECT packet_id, CASE ({sql.private_prefix('src_ip')}) * 2 + ({sql.private_prefix('dst_ip')})
 WHEN 3 THEN 'internal' WHEN 2 THEN 'internal_to_external' WHEN 1 THEN 'external_to_internal'
 ELSE 'external' END AS context FROM packets""",
)
def net_context(packets):
    return packets.select(
        "packet_id", network_context(F.col("src_ip"), F.col("dst_ip")).alias("context")
    )


@query(
    "ttl_class",
    f" SELECT packet_id, ttl, {sql.one('ttl < 64')} AS low, {sql.one('ttl <= 30')} AS very_low FROM packets",
)
def ttl_class(packets):
    ttl = F.col("ttl")
    return packets.select(
        "packet_id", "ttl", rules.ttl_low(ttl).alias("low"), rules.ttl_very_low(ttl).alias("very_low")
    )


@query(
    "window_class",
    """ SELECT packet_id, CASE WHEN protocol <> 'TCP' OR tcp_window IS NULL THEN NULL WHEN tcp_window < 1000 THEN 'small'
 WHEN tcp_window > 65000 THEN 'large' ELSE 'normal' END AS window_class FROM packets""",
)
def window_class(packets):
    size = rules.on_tcp(F.col("protocol"), rules.window_class(F.col("tcp_window")))
    return packets.select("packet_id", size.alias("window_class"))


@query(
    "size_class",
    """ SELECT packet_id, CASE WHEN length < 60 THEN 'small' WHEN length > 1400 THEN 'large'
 WHEN length IS NOT NULL THEN 'medium' END AS size_class FROM packets""",
)
def size_class(packets):
    return packets.select("packet_id", rules.size_class(F.col("length")).alias("size_class"))


@query(
    "high_ports",
    """ SELECT packet_id, concat_ws(', ', CASE WHEN src_port > 1023 THEN CAST(src_port AS VARCHAR) END,
 CASE WHEN dst_port > 1023 THEN CAST(dst_port AS VARCHAR) END) AS high_ports FROM packets""",
)
def high_ports(packets):
    return packets.select(
        "packet_id", rules.high_ports(F.col("src_port"), F.col("dst_port")).alias("high_ports")
    )


@query(
    "port_meaning",
    """, t AS (SELECT packet_id, upper(protocol) AS transport, src_port, dst_port FROM packets)
SELECT packet_id, CASE WHEN transport = 'TCP' AND 80 IN (src_port, dst_port) THEN 'web'
 WHEN transport = 'TCP' AND 443 IN (src_port, dst_port) THEN 'secure_web'
 WHEN transport = 'UDP' AND 53 IN (src_port, dst_port) THEN 'name_lookup' END AS meaning FROM t""",
)
def port_meaning(packets):
    return packets.select(
        "packet_id",
        rules.port_meaning(F.col("protocol"), F.col("src_port"), F.col("dst_port")).alias("meaning"),
    )


@query(
    "icmp_meaning",
    """ SELECT packet_id, icmp_type, icmp_code, CASE WHEN icmp_type = 0 THEN 'echo_reply'
 WHEN icmp_type = 3 THEN CASE icmp_code WHEN 0 THEN 'network_unreachable' WHEN 1 THEN 'host_unreachable'
  WHEN 3 THEN 'port_unreachable' ELSE 'unreachable' END
 WHEN icmp_type = 8 THEN 'echo_request' WHEN icmp_type = 11 THEN 'time_exceeded' END AS icmp_meaning FROM packets""",
)
def icmp_meaning(packets):
    return with_icmp_meaning(packets.select("packet_id", "icmp_type", "icmp_code"))


@query(
    "http_meaning",
    """ SELECT packet_id, CASE http_method WHEN 'GET' THEN 'read' WHEN 'POST' THEN 'submit'
 WHEN 'HEAD' THEN 'check' END AS meaning FROM packets""",
)
def http_meaning(packets):
    return packets.select("packet_id", rules.http_meaning(F.col("http_method")).alias("meaning"))


@query(
    "proto_family",
    f""", {sql.values(PROTOCOL_FAMILIES, 'k, family', 'families')}
SELECT packet_id, protocol, coalesce(family, 'specialized') AS protocol_family
FROM packets LEFT JOIN families ON upper(protocol) = families.k""",
)
def proto_family(packets):
    return with_protocol_family(packets.select("packet_id", "protocol"))


_PROBES = "(0, 1, 21, 22, 23, 25, 53, 1080, 1337, 4444, 6667, 6668, 6669, 8080, 8888, 9001, 9002, 12345, 31337)"


@query(
    "sig_hits",
    f""" SELECT 'all_flags' AS signature, count(*) FILTER (WHERE {_M} & 63 = 63) AS n FROM packets
 UNION ALL SELECT 'syn_rst_fin', count(*) FILTER (WHERE {_M} & 7 = 7) FROM packets
 UNION ALL SELECT 'invalid_icmp', count(*) FILTER (WHERE icmp_type BETWEEN 41 AND 44 OR icmp_code = 200) FROM packets
 UNION ALL SELECT 'probe_port', count(*) FILTER (WHERE src_port IN {_PROBES} OR dst_port IN {_PROBES}) FROM packets""",
)
def sig_hits(packets):
    return rules.signature_counts(packets)
