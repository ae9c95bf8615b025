"""SQL texts shared by several checks, written for a plain SQL engine."""

from __future__ import annotations

import ipaddress

from packetscope.constants import PRIVATE_V4, PUBLIC_V4_EXCEPTIONS


def values(rows: list[tuple], columns: str, name: str) -> str:
    def literal(v) -> str:
        if v is None:
            return "NULL"
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
    return f"{name} AS (SELECT * FROM (VALUES {body}) AS t({columns}))"


def ip_number(c: str) -> str:
    a, b, d, e = (f"CAST(split_part({c}, '.', {i}) AS BIGINT)" for i in (1, 2, 3, 4))
    return f"({a} * 16777216 + {b} * 65536 + {d} * 256 + {e})"


def private_registry(c: str) -> str:
    n = ip_number(c)
    ranges = " OR ".join(
        f"{n} BETWEEN {int(ipaddress.IPv4Address(a))} AND {int(ipaddress.IPv4Address(b))}"
        for a, b in PRIVATE_V4
    )
    carved = ", ".join(str(int(ipaddress.IPv4Address(a))) for a in PUBLIC_V4_EXCEPTIONS)
    return f"CASE WHEN {c} IS NOT NULL AND ({ranges}) AND {n} NOT IN ({carved}) THEN 1 ELSE 0 END"


def private_prefix(c: str) -> str:
    middle = " OR ".join(f"{c} LIKE '172.{i}.%'" for i in range(16, 32))
    return (
        f"CASE WHEN {c} LIKE '10.%' OR {c} LIKE '127.%' OR {c} LIKE '192.168.%' OR {middle}"
        " THEN 1 ELSE 0 END"
    )


def direction(src: str = "src_ip", dst: str = "dst_ip") -> str:
    a, b = private_prefix(src), private_prefix(dst)
    return (
        f"CASE ({a}) * 2 + ({b}) WHEN 3 THEN 'Local' WHEN 2 THEN 'Outbound'"
        " WHEN 1 THEN 'Inbound' ELSE 'External' END"
    )


def packet_direction() -> str:
    return (
        "CASE WHEN protocol = 'ARP' THEN CASE WHEN dst_ip = '255.255.255.255' THEN 'Broadcast'"
        f" ELSE 'Local' END ELSE {direction()} END"
    )


TRANSPORT = (
    "CASE WHEN protocol IN ('TCP','HTTP','HTTP (Raw)','TLS','HTTPS','FTP','SSH','TELNET') THEN 'TCP'"
    " WHEN protocol IN ('UDP','DNS','DHCP','SNMP') THEN 'UDP'"
    " WHEN protocol = 'ICMP' THEN 'ICMP' ELSE 'Other' END"
)


def flag_names(mask: str, separator: str = " ") -> str:
    bits = ["FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWR"]
    parts = ", ".join(f"CASE WHEN {mask} & {1 << i} <> 0 THEN '{b}' END" for i, b in enumerate(bits))
    return (
        f"CASE WHEN {mask} IS NULL THEN NULL WHEN {mask} = 0 THEN 'None'"
        f" ELSE concat_ws('{separator}', {parts}) END"
    )


def one(condition: str) -> str:
    """Condition as 0/1, unknown as 0."""
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def any_like(c: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"strpos(lower({c}), '{n}') > 0" for n in needles) + ")"


_PORTS = "(22, 23, 25, 135, 445, 1433, 3306, 3389, 5900, 8080, 8888)"
_M = "tcp_flags_mask"
_ODD_FLAGS = one(f"{_M} & 20 = 20 OR {_M} & 5 = 5 OR {_M} & 3 = 3")
_TLD = any_like("dns_query", [".xyz", ".top", ".pw", ".cc", ".tk"])
_PATH = any_like(
    "http_path", ["/admin", "/wp-login", "/shell", "/cmd", "/exec", "/phpmyadmin"]
)
_HOST = any_like("http_host", ["malware.com", "badsite.com", "evil.net", "attacker.org"])


def _is(name: str) -> str:
    return one(f"strpos(upper(protocol), '{name}') > 0")


BASIC = f"""
basic0 AS (SELECT packet_id, coalesce(protocol, '') AS protocol_str,
  {_is('TCP')} AS is_tcp, {_is('UDP')} AS is_udp, {_is('ICMP')} AS is_icmp,
  {_is('HTTP')} AS is_http_basic, {_is('DNS')} AS is_dns_basic, {_is('ARP')} AS is_arp_basic,
  {private_registry('src_ip')} AS src_ip_is_private,
  {private_registry('dst_ip')} AS dst_ip_is_private,
  {one(f'src_port IN {_PORTS}')} AS src_port_suspicious,
  {one(f'dst_port IN {_PORTS}')} AS dst_port_suspicious,
  {_ODD_FLAGS} AS has_suspicious_flags,
  {one(f'{_M} & 2 <> 0')} AS has_syn_basic, {one(f'{_M} & 4 <> 0')} AS has_rst_basic,
  {one(f'{_M} & 1 <> 0')} AS has_fin_basic, {one(f'{_M} & 16 <> 0')} AS has_ack_basic,
  {one(f"({packet_direction()}) = 'Inbound'")} AS is_inbound,
  {one(f"({packet_direction()}) = 'Outbound'")} AS is_outbound,
  CAST(coalesce(length, 0) AS DOUBLE) AS packet_length, {one('length > 1500')} AS is_large_packet,
  CAST(coalesce(ttl, 0) AS DOUBLE) AS ttl, {one('coalesce(ttl, 0) < 32')} AS has_low_ttl_basic,
  {one("dns_query <> ''")} AS has_dns_query_basic, {one(_TLD)} AS has_suspicious_dns_query_basic,
  {one("http_method <> ''")} AS has_http_method_basic,
  {one(_PATH)} AS has_suspicious_http_path_basic, {one(_HOST)} AS has_suspicious_http_host_basic
  FROM packets),
basic AS (SELECT *, greatest(src_port_suspicious, dst_port_suspicious, has_suspicious_flags,
  has_suspicious_dns_query_basic, has_suspicious_http_path_basic,
  has_suspicious_http_host_basic) AS is_threat FROM basic0)
"""

DETAILED = f"""
detailed0 AS (SELECT packet_id, coalesce(protocol, '') AS protocol_str,
  {', '.join(f'{_is(n)} AS is_{n.lower()}' for n in ('TCP', 'UDP', 'ICMP', 'HTTP', 'DNS', 'TLS', 'SNMP', 'DHCP', 'ARP'))},
  {private_registry('src_ip')} AS src_ip_is_private,
  {private_registry('dst_ip')} AS dst_ip_is_private,
  {one(f'src_port IN {_PORTS}')} AS src_port_suspicious,
  {one(f'dst_port IN {_PORTS}')} AS dst_port_suspicious,
  {_ODD_FLAGS} AS has_suspicious_flags,
  {', '.join(f"{one(f'{_M} & {b} <> 0')} AS has_{n}" for n, b in (('syn', 2), ('rst', 4), ('fin', 1), ('ack', 16), ('psh', 8), ('urg', 32)))},
  CAST(coalesce(ttl, 0) AS DOUBLE) AS ttl, {one('coalesce(ttl, 0) < 32')} AS has_low_ttl,
  {one("http_method <> ''")} AS has_http_method,
  {one("http_method = 'GET'")} AS is_http_get, {one("http_method = 'POST'")} AS is_http_post,
  {one(_PATH)} AS has_suspicious_http_path, {one(_HOST)} AS has_suspicious_http_host,
  {one("dns_query <> ''")} AS has_dns_query, {one(_TLD)} AS has_suspicious_dns_query,
  {one('icmp_type = 8 AND icmp_code = 0')} AS is_icmp_scan,
  {one('tls_version IS NOT NULL')} AS has_tls_info,
  {one('tls_version IN (768, 769)')} AS has_obsolete_tls,
  {one("arp_opcode = 'request'")} AS is_arp_request, {one("arp_opcode = 'reply'")} AS is_arp_reply,
  CAST(coalesce(length, 0) AS DOUBLE) AS packet_length, {one('length > 1500')} AS is_large_packet,
  CAST(coalesce(udp_length, 0) AS DOUBLE) AS udp_length_val,
  {one('http_status BETWEEN 400 AND 499')} AS http_status_client_error,
  {one('http_status BETWEEN 500 AND 599')} AS http_status_server_error,
  {one('dns_qtype = 255')} AS dns_qtype_is_any,
  {one('tls_content_type = 22')} AS tls_is_handshake,
  {one('tls_content_type = 23')} AS tls_is_app_data,
  {one('tls_handshake_type = 1')} AS tls_is_client_hello
  FROM packets),
detailed AS (SELECT *, greatest(src_port_suspicious, dst_port_suspicious, has_suspicious_flags,
  has_suspicious_http_path, has_suspicious_http_host, has_suspicious_dns_query, has_obsolete_tls,
  is_icmp_scan, dns_qtype_is_any, tls_is_handshake, tls_is_app_data, tls_is_client_hello,
  http_status_client_error, http_status_server_error) AS is_threat FROM detailed0)
"""

SCORED = f"""{DETAILED},
fired AS (SELECT packet_id, is_threat, src_port_suspicious + dst_port_suspicious
  + has_suspicious_flags + has_suspicious_http_path + has_suspicious_dns_query AS f FROM detailed),
scored AS (SELECT packet_id, is_threat AS label, CAST(f AS DOUBLE) / 5 AS score,
  CASE WHEN f > 0 THEN 1 ELSE 0 END AS prediction FROM fired)
"""


def _mac_digits(c: str) -> str:
    return f"upper(replace({c}, ':', ''))"


def _ip_digits(c: str) -> str:
    return " || ".join(f"printf('%02X', CAST(split_part({c}, '.', {i}) AS INT))" for i in (1, 2, 3, 4))


# Bytes of every packet as hex digits: payload, transport part, whole frame.
FRAMES = f"""
payloads AS (SELECT *, CASE protocol
  WHEN 'HTTP' THEN hex(http_method || ' ' || http_path || ' HTTP/1.1' || chr(13) || chr(10) || 'Host: '
    || http_host || chr(13) || chr(10) || chr(13) || chr(10))
  WHEN 'HTTP (Raw)' THEN hex('.. GET /part/' || packet_id || chr(13) || chr(10) || 'rest')
  WHEN 'TLS' THEN printf('%02X%04X', tls_content_type, tls_version)
    || CASE WHEN tls_handshake_type IS NULL THEN '0002FFFF' ELSE printf('0004%02X000000', tls_handshake_type) END
  WHEN 'DNS' THEN printf('%04X', packet_id % 65536) || '01000001000000000000'
    || printf('%02X', length(split_part(dns_query, '.', 1))) || hex(split_part(dns_query, '.', 1))
    || printf('%02X', length(split_part(dns_query, '.', 2))) || hex(split_part(dns_query, '.', 2))
    || printf('%02X', length(split_part(dns_query, '.', 3))) || hex(split_part(dns_query, '.', 3))
    || '00' || printf('%04X', dns_qtype) || '0001'
  WHEN 'DHCP' THEN '01010600' || printf('%08X', packet_id) || repeat('00', 228) || '63825363'
    || printf('3501%02X', dhcp_type_code) || 'FF'
  WHEN 'SNMP' THEN printf('30%02X', 42 + length(CAST(packet_id AS VARCHAR)))
    || '0201010406' || hex('public')
    || printf('%02X%02X', 160 + snmp_pdu_code, 29 + length(CAST(packet_id AS VARCHAR)))
    || printf('0204%08X', packet_id) || '020100020100'
    || printf('30%02X30%02X', 15 + length(CAST(packet_id AS VARCHAR)), 13 + length(CAST(packet_id AS VARCHAR)))
    || '06082B06010201010100' || printf('04%02X', 1 + length(CAST(packet_id AS VARCHAR)))
    || hex('v' || packet_id)
  ELSE '' END AS payload_hex, {TRANSPORT} AS transport FROM packets),
bodies AS (SELECT *, CASE transport
  WHEN 'TCP' THEN printf('%04X%04X', src_port, dst_port) || '000000010000000150'
    || printf('%02X%04X', tcp_flags_mask, tcp_window % 65536) || '00000000' || payload_hex
  WHEN 'UDP' THEN printf('%04X%04X%04X', src_port, dst_port, 8 + length(payload_hex) // 2) || '0000' || payload_hex
  WHEN 'ICMP' THEN printf('%02X%02X', icmp_type, icmp_code) || '000000010001'
  ELSE '' END AS body_hex FROM payloads),
frames AS (SELECT *, {_mac_digits('dst_mac')} || {_mac_digits('src_mac')}
  || CASE WHEN protocol = 'ARP' THEN '080600010800060400' || CASE arp_opcode WHEN 'request' THEN '01' ELSE '02' END
    || {_mac_digits('src_mac')} || {_ip_digits('src_ip')} || {_mac_digits('dst_mac')} || {_ip_digits('dst_ip')}
  ELSE '08004500' || printf('%04X', 20 + length(body_hex) // 2) || printf('%04X', packet_id % 65536)
    || '4000' || printf('%02X', ttl)
    || CASE transport WHEN 'TCP' THEN '06' WHEN 'UDP' THEN '11' ELSE '01' END || '0000'
    || {_ip_digits('src_ip')} || {_ip_digits('dst_ip')} || body_hex END AS frame_hex
  FROM bodies)
"""
