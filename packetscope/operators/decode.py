"""Frame bytes to typed columns.

Layers are found by walking: VLAN tags shift the network header, IPv4 options and the
IPv6 extension headers shift the transport header. Header fields are read natively from the
frame's bytes at those places; only DNS, DHCP and SNMP bodies go through Python (see
``appdata``). Every read is guarded by the frame length, so a short frame gives NULL,
never garbage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetscope.constants import HTTP_LINE_MARKS, HTTP_PORTS, TLS_PORTS
from packetscope.functions.addresses import packet_direction
from packetscope.functions.flags import flag_names
from packetscope.functions.text import any_of, hex_text, safe_decode
from packetscope.operators.appdata import FIELDS, app_fields, app_kind
from packetscope.operators.lookups import (
    protocol_fallback,
    with_arp_name,
    with_dhcp_name,
    with_snmp_name,
)
from packetscope.plans.staged import computed_once
from packetscope.session import ship

_ETHERNET = 14
_IPV6 = 40
# types that announce a VLAN tag (802.1Q, 802.1ad)
_TAGS = (0x8100, 0x88A8)
# IPv6 extension headers counted in units of eight bytes, besides fragment and authentication
_OPTIONS, _FRAGMENT, _AUTHENTICATION = (0, 43, 60, 135, 139, 140), 44, 51


def _number_sql(at: str | int, octets: int) -> str:
    return f"CAST(conv(hex(substring(frame, ({at}) + 1, {octets})), 16, 10) AS BIGINT)"


def _word(at: str | int, octets: int) -> Column:
    """Up to seven bytes of the frame as one BIGINT; NULL past the end.

    ``at`` is an offset or SQL for one. Turning bytes into a number is the costly
    step, so neighbouring fields are read as one word and taken apart.
    """
    return F.expr(f"CASE WHEN __size >= {at} + {octets} THEN {_number_sql(at, octets)} END")


def _part_sql(word: str, below: int, octets: int) -> str:
    return f"(shiftright({word}, {8 * below}) & {(1 << (8 * octets)) - 1}L)"


def _part(word: str, below: int, octets: int) -> Column:
    """A field of a word with ``below`` bytes after it."""
    return F.expr(f"CAST({_part_sql(word, below, octets)} AS INT)")


def _ip_text(word: str) -> Column:
    octets = ", ".join(f"CAST({_part_sql(word, i, 1)} AS STRING)" for i in (3, 2, 1, 0))
    return F.expr(f"CASE WHEN {word} IS NOT NULL THEN concat_ws('.', {octets}) END")


def _mac(at: str | int) -> Column:
    digits = f"lower(hex(substring(frame, ({at}) + 1, 6)))"
    pairs = f"substring(regexp_replace({digits}, '(..)', '$1:'), 1, 17)"
    return F.expr(f"CASE WHEN __size >= {at} + 6 THEN {pairs} END")


def _ip6_groups(digits: str) -> Column:
    """Eight groups of 32 hex digits, without leading zeros."""
    spaced = f"regexp_replace({digits}, '(....)', '$1:')"
    return F.expr(f"rtrim(':', regexp_replace({spaced}, '0{{0,3}}([0-9a-f]+):', '$1:'))")


def _ip6_text(groups: str) -> Column:
    """Shortest form of an address: the first longest run of zero groups becomes ``::``.

    IPv4 addresses mapped to IPv6 keep their dots. ``groups`` is a column made by
    :func:`_ip6_groups`.
    """
    runs = " ".join(
        f"WHEN {groups} RLIKE '(^|:)0(:0){{{n - 1}}}(:|$)' THEN"
        f" regexp_replace({groups}, '^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|$)(.*)$', '$1::$2')"
        for n in range(8, 1, -1)
    )
    octets = [
        f"conv(substring(lpad(split_part({groups}, ':', {g}), 4, '0'), {at}, 2), 16, 10)"
        for g in (7, 8) for at in (1, 3)
    ]
    return F.expr(
        f"CASE WHEN {groups} LIKE '0:0:0:0:0:ffff:%' THEN concat('::ffff:', concat_ws('.', {', '.join(octets)}))"
        f" {runs} ELSE {groups} END"
    )


def _stage(df: DataFrame) -> DataFrame:
    return computed_once(df, {"__size": F.octet_length("frame")})


def _unstage(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def _add_ethernet(df: DataFrame) -> DataFrame:
    """Addresses, the type field, and VLAN tags.

    ``ethertype`` is what stands behind the addresses; ``vlan_depth`` tags may follow, of
    which the outermost and the innermost id are given. The network header starts at
    ``__l3``, its type is ``__type``. Any number of stacked tags is followed.
    """
    staged = computed_once(
        df, {"src_mac": _mac(6), "dst_mac": _mac(0), "ethertype": _word(12, 2).cast("int")}
    )
    codes = "|".join(f"{t:04X}" for t in _TAGS)
    # only tagged frames are matched; a tag is a type and two bytes, and ends with the next type
    tags = f"regexp_extract(hex(substring(frame, 13)), '^((?:(?:{codes})....(?=....))+)', 1)"
    is_tagged = f"ethertype IN ({', '.join(map(str, _TAGS))})"
    staged = computed_once(
        staged, {"__l3": F.expr(f"{_ETHERNET} + CASE WHEN {is_tagged} THEN length({tags}) DIV 2 ELSE 0 END")}
    )
    depth = f"CAST((__l3 - {_ETHERNET}) DIV 4 AS INT)"
    return computed_once(
        staged,
        {
            "vlan_depth": F.expr(depth),
            "vlan_outer": F.when(F.expr(f"{depth} > 0"), _word(14, 2).bitwiseAND(F.lit(0xFFF))).cast("int"),
            "vlan_inner": F.when(
                F.expr(f"{depth} > 0"), _word("__l3 - 4", 2).bitwiseAND(F.lit(0xFFF))
            ).cast("int"),
            "__type": _word("__l3 - 2", 2).cast("int"),
        },
    )


def _walked_sql() -> str:
    """Transport protocol, place and fragment word behind the IPv6 extension headers.

    Every header has eight bytes at least, so the steps suffice for any chain. A chain
    that the frame's end cuts short keeps the number of the header it ends in.
    """
    known = ", ".join(map(str, (*_OPTIONS, _FRAGMENT, _AUTHENTICATION)))
    first = (
        "named_struct('next', CAST(__next AS INT), 'at', CAST(__l3 + 40 AS INT), 'fragment', CAST(NULL AS INT))"
    )

    def octet(at: str) -> str:
        return f"CAST({_number_sql(at, 1)} AS INT)"

    size = (
        f"CASE s.next WHEN {_FRAGMENT} THEN 8 WHEN {_AUTHENTICATION} THEN 4 * ({octet('s.at + 1')} + 2)"
        f" ELSE 8 * ({octet('s.at + 1')} + 1) END"
    )
    fragment = f"CASE WHEN s.next = {_FRAGMENT} THEN CAST({_number_sql('s.at + 2', 2)} AS INT) ELSE s.fragment END"
    step = (
        f"CASE WHEN s.next IN ({known}) AND coalesce(s.fragment, 0) < 8 AND __size >= s.at + 8 THEN"
        f" named_struct('next', {octet('s.at')}, 'at', s.at + {size}, 'fragment', {fragment}) ELSE s END"
    )
    steps = f"sequence(1, greatest(1, CAST((__size - __l3) DIV 8 AS INT)))"
    return f"CASE WHEN __next IN ({known}) THEN aggregate({steps}, {first}, (s, i) -> {step}) ELSE {first} END"


def _add_ip(df: DataFrame) -> DataFrame:
    """IPv4 and IPv6 columns, NULL for other frames.

    Flag bits of IPv4 by RFC 791: 4 reserved, 2 don't fragment, 1 more fragments. The
    fragment offset is given in units of eight bytes and in bytes. ``ttl`` is the hop limit
    of IPv6, ``ip_proto`` the protocol behind its extension headers.
    """
    is_v4 = (F.col("__type") == 0x0800) & (F.col("__size") >= F.col("__l3") + 20)
    is_v6 = (F.col("__type") == 0x86DD) & (F.col("__size") >= F.col("__l3") + _IPV6)
    words = {"__w0": (0, 6), "__w6": (6, 6), "__w12": (12, 4), "__w16": (16, 4)}
    staged = computed_once(
        df,
        {name: F.when(is_v4, _word(f"__l3 + {at}", size)) for name, (at, size) in words.items()}
        | {
            "__v0": F.when(is_v6, _word("__l3", 4)),
            "__v4": F.when(is_v6, _word("__l3 + 4", 4)),
            "__v8": F.when(is_v6, _ip6_groups("lower(hex(substring(frame, __l3 + 9, 16)))")),
            "__v24": F.when(is_v6, _ip6_groups("lower(hex(substring(frame, __l3 + 25, 16)))")),
        },
    )
    staged = computed_once(staged, {"__next": _part("__v4", 1, 1)})
    staged = computed_once(
        staged, {"__walk": F.when(F.col("__next").isNotNull(), F.expr(_walked_sql()))}
    )
    v4, v6 = _part("__w6", 4, 2), F.col("__walk.fragment")
    first = computed_once(
        staged,
        {
            "ip_version": F.coalesce(F.shiftright(_part("__w0", 5, 1), 4), F.shiftright("__v0", 28).cast("int")),
            "ip_ihl": _part("__w0", 5, 1).bitwiseAND(F.lit(15)),
            "ip_dscp_ecn": F.coalesce(_part("__w0", 4, 1), F.expr("CAST(shiftright(__v0, 20) & 255 AS INT)")),
            "ip_total_length": _part("__w0", 2, 2),
            "ip_id": _part("__w0", 0, 2),
            "ip_flags": F.shiftright(v4, 13),
            "ip_fragment_offset": F.coalesce(v4.bitwiseAND(F.lit(0x1FFF)), F.shiftright(v6, 3)),
            "ttl": F.coalesce(_part("__w6", 3, 1), _part("__v4", 0, 1)),
            "ip_proto": F.coalesce(_part("__w6", 2, 1), F.col("__walk.next")),
            "ip_checksum": _part("__w6", 0, 2),
            "ip6_flow_label": F.expr("CAST(__v0 & 1048575 AS INT)"),
            "ip6_payload_length": _part("__v4", 2, 2),
            "ip6_next_header": F.col("__next"),
            "src_ip": F.coalesce(_ip_text("__w12"), _ip6_text("__v8")),
            "dst_ip": F.coalesce(_ip_text("__w16"), _ip6_text("__v24")),
        },
    )
    # later fragments carry no transport header
    header = F.coalesce(F.col("__l3") + F.col("ip_ihl") * 4, F.col("__walk.at"))
    header = F.when(F.coalesce("ip_fragment_offset", F.lit(0)) == 0, header)
    # a zero length means the sender left it to the hardware, or a jumbogram
    size = F.nullif(
        F.coalesce(F.col("ip_total_length"), F.col("ip6_payload_length") + F.lit(_IPV6)),
        F.when(F.col("ip_ihl").isNotNull(), 0).otherwise(_IPV6),
    )
    end = F.coalesce(F.least(F.col("__size"), F.col("__l3") + size), F.col("__size"))
    placed = computed_once(first, {"__l4": header, "__end": end})
    return placed.withColumn("ip_fragment_bytes", F.col("ip_fragment_offset") * 8)


def _add_tcp(df: DataFrame) -> DataFrame:
    known = (F.col("ip_proto") == 6) & (F.col("__size") >= F.col("__l4") + 20)
    words = {"__t0": (0, 4), "__t4": (4, 4), "__t8": (8, 4), "__t12": (12, 4), "__t16": (16, 4)}
    staged = computed_once(
        df, {name: F.when(known, _word(f"__l4 + {start}", size)) for name, (start, size) in words.items()}
    )
    return computed_once(
        staged,
        {
            "tcp_src_port": _part("__t0", 2, 2),
            "tcp_dst_port": _part("__t0", 0, 2),
            "tcp_seq": F.col("__t4"),
            "tcp_ack": F.col("__t8"),
            "tcp_data_offset": F.shiftright(_part("__t12", 3, 1), 4),
            "tcp_flags_mask": _part("__t12", 2, 1),
            "tcp_window": _part("__t12", 0, 2),
            "tcp_checksum": _part("__t16", 2, 2),
            "tcp_urgent": _part("__t16", 0, 2),
        },
    )


def _add_udp(df: DataFrame) -> DataFrame:
    known = (F.col("ip_proto") == 17) & (F.col("__size") >= F.col("__l4") + 8)
    words = {"__u0": F.when(known, _word("__l4", 4)), "__u4": F.when(known, _word("__l4 + 4", 4))}
    return computed_once(
        computed_once(df, words),
        {
            "udp_src_port": _part("__u0", 2, 2),
            "udp_dst_port": _part("__u0", 0, 2),
            "udp_length": _part("__u4", 2, 2),
            "udp_checksum_value": _part("__u4", 0, 2),
        },
    )


def _add_icmp(df: DataFrame) -> DataFrame:
    # type and code may be all a short frame has, so they are read one by one
    known = (F.col("ip_proto") == 1) & F.col("ip_ihl").isNotNull()
    return computed_once(
        df,
        {
            "icmp_type": F.when(known, _word("__l4", 1)).cast("int"),
            "icmp_code": F.when(known, _word("__l4 + 1", 1)).cast("int"),
            "icmp6_type": F.when(F.col("ip_proto") == 58, _word("__l4", 1)).cast("int"),
            "icmp6_code": F.when(F.col("ip_proto") == 58, _word("__l4 + 1", 1)).cast("int"),
        },
    )


def _add_arp(df: DataFrame) -> DataFrame:
    known = (F.col("__type") == 0x0806) & (F.col("__size") >= F.col("__l3") + 28)
    staged = computed_once(
        df,
        {"__a14": F.when(known, _word("__l3 + 14", 4)), "__a24": F.when(known, _word("__l3 + 24", 4))},
    )
    columns = {
        "arp_op": F.when(known, _word("__l3 + 6", 2)).cast("int"),
        "arp_src_mac": F.when(known, _mac("__l3 + 8")),
        "arp_src_ip": _ip_text("__a14"),
        "arp_dst_mac": F.when(known, _mac("__l3 + 18")),
        "arp_dst_ip": _ip_text("__a24"),
    }
    return computed_once(staged, columns)


def _add_payload(df: DataFrame) -> DataFrame:
    """Transport payload, Ethernet padding cut off; NULL without a transport header."""
    start = F.when(
        F.col("tcp_data_offset").isNotNull(), F.col("__l4") + F.col("tcp_data_offset") * 4
    ).when(F.col("udp_length").isNotNull(), F.col("__l4") + 8)
    size = F.greatest(F.col("__end") - start, F.lit(0))
    return computed_once(df, {"payload": F.substring(F.col("frame"), start + 1, size)})


def ethernet(df: DataFrame) -> DataFrame:
    return _unstage(_add_ethernet(_stage(df)))


def _ip(df: DataFrame) -> DataFrame:
    return _add_ip(_add_ethernet(_stage(df)))


def ipv4(df: DataFrame) -> DataFrame:
    return _unstage(_ip(df).filter(F.col("ip_ihl").isNotNull()))


def ipv6(df: DataFrame) -> DataFrame:
    return _unstage(_ip(df).filter(F.col("ip6_next_header").isNotNull()))


def tcp(df: DataFrame) -> DataFrame:
    return _unstage(_add_tcp(_ip(df)).filter(F.col("tcp_src_port").isNotNull()))


def udp(df: DataFrame) -> DataFrame:
    return _unstage(_add_udp(_ip(df)).filter(F.col("udp_src_port").isNotNull()))


def icmp(df: DataFrame) -> DataFrame:
    return _unstage(_add_icmp(_ip(df)).filter(F.col("icmp_type").isNotNull()))


def arp(df: DataFrame) -> DataFrame:
    decoded = _unstage(_add_arp(_add_ethernet(_stage(df))).filter(F.col("arp_op").isNotNull()))
    return with_arp_name(decoded)


def _on_ports(src: str, dst: str, ports: list[int]) -> Column:
    return F.coalesce(F.col(src).isin(ports) | F.col(dst).isin(ports), F.lit(False))


_REQUEST = r"^(GET|POST|HEAD|PUT|DELETE|OPTIONS|PATCH|TRACE|CONNECT) (\S+) HTTP/\d(?:\.\d)?$"
_STATUS = r"^HTTP/\d(?:\.\d)? (\d{3})(?: .*)?$"


def _add_http(df: DataFrame) -> DataFrame:
    """Request and status fields on HTTP ports; ``http_raw`` holds an unparsed first line."""
    on_port = _on_ports("tcp_src_port", "tcp_dst_port", HTTP_PORTS)
    staged = computed_once(df, {"__text": F.when(on_port, safe_decode(F.col("payload")))})
    line = F.split_part(F.col("__text"), F.lit("\r\n"), F.lit(1))
    staged = computed_once(staged, {"__line": line})

    def part(pattern: str, group: int, of: str = "__line") -> Column:
        return F.nullif(F.regexp_extract(F.col(of), pattern, group), F.lit(""))

    status = part(_STATUS, 1).cast("int")
    staged = computed_once(staged, {"http_method": part(_REQUEST, 1), "http_status": status})
    is_request = F.col("http_method").isNotNull()
    is_http = is_request | F.col("http_status").isNotNull()
    marked = any_of([F.col("__line").contains(m) for m in HTTP_LINE_MARKS])
    return staged.withColumns(
        {
            "http_host": F.when(is_request, part(r"(?im)^Host:[ \t]*([^\r\n]*)", 1, "__text")),
            "http_path": F.when(is_request, part(_REQUEST, 2)),
            "http_raw": F.when(~is_http & marked, F.col("__line")),
        }
    ).drop("__text", "__line")


def _add_tls(df: DataFrame) -> DataFrame:
    """Record header on TLS ports, and the type of a first handshake message."""
    staged = computed_once(df, {"__tls": F.hex(F.substring(F.col("payload"), 1, 6))})
    digits = F.col("__tls")

    def value(start: int, octets: int) -> Column:
        return F.conv(F.substring(digits, start * 2 + 1, octets * 2), 16, 10).cast("int")

    is_record = (
        _on_ports("tcp_src_port", "tcp_dst_port", TLS_PORTS)
        & (F.octet_length("payload") >= 5)
        & value(0, 1).between(20, 24)
        & (value(1, 1) == 3)
    )
    is_handshake = is_record & (value(0, 1) == 22) & (F.octet_length("payload") >= 6)
    columns = {
        "tls_content_type": F.when(is_record, value(0, 1)),
        "tls_version": F.when(is_record, value(1, 2)),
        "tls_handshake_type": F.when(is_handshake, value(5, 1)),
    }
    return computed_once(staged, columns).drop("__tls")


def _add_app(df: DataFrame) -> DataFrame:
    ship(df.sparkSession)
    kind = app_kind(F.col("udp_src_port"), F.col("udp_dst_port"))
    staged = df.withColumn("__kind", kind)
    payload = F.when(F.col("__kind").isNotNull(), F.col("payload"))
    staged = staged.withColumn("__app", app_fields(F.col("__kind"), payload))
    return staged.withColumns({n: F.col(f"__app.{n}") for n in FIELDS})


def http(df: DataFrame) -> DataFrame:
    """TCP frames whose payload is an HTTP request, response or part of one."""
    decoded = _add_http(_add_payload(_add_udp(_add_tcp(_ip(df)))))
    found = F.coalesce("http_method", F.col("http_status").cast("string"), "http_raw")
    return _unstage(decoded.filter(found.isNotNull()))


def application(df: DataFrame) -> DataFrame:
    """Frames with a DNS, DHCP, SNMP or TLS payload and its fields."""
    decoded = _add_app(_add_tls(_add_payload(_add_udp(_add_tcp(_ip(df))))))
    known = F.coalesce("app_protocol", F.when(F.col("tls_version").isNotNull(), F.lit("TLS")))
    decoded = decoded.withColumn("app_protocol", known).filter(known.isNotNull())
    return with_snmp_name(with_dhcp_name(_unstage(decoded)))


def layers(df: DataFrame) -> DataFrame:
    """All header columns and the payload, nothing named yet."""
    return _add_payload(_add_arp(_add_icmp(_add_udp(_add_tcp(_ip(df))))))


def frame_headers(df: DataFrame) -> DataFrame:
    return _unstage(layers(df))


def decode_frames(df: DataFrame) -> DataFrame:
    """Canonical packet rows of frames: TCP, then UDP, ICMP, ARP, other IP."""
    full = _add_app(_add_tls(_add_http(layers(df))))
    is_http = F.coalesce("http_method", F.col("http_status").cast("string")).isNotNull()
    protocol = (
        F.when(
            F.col("tcp_src_port").isNotNull(),
            F.when(F.col("tls_version").isNotNull(), F.lit("TLS"))
            .when(is_http, F.lit("HTTP"))
            .when(F.col("http_raw").isNotNull(), F.lit("HTTP (Raw)"))
            .otherwise(F.lit("TCP")),
        )
        .when(F.col("udp_src_port").isNotNull(), F.coalesce("app_protocol", F.lit("UDP")))
        .when(F.col("icmp_type").isNotNull(), F.lit("ICMP"))
        .when(F.col("arp_op").isNotNull(), F.lit("ARP"))
        .when(F.col("ip_proto").isNotNull(), protocol_fallback(F.col("ip_proto")))
        .otherwise(F.lit("Unknown"))
    )
    named = full.withColumns(
        {
            "protocol": protocol,
            "src_ip": F.coalesce("src_ip", "arp_src_ip"),
            "dst_ip": F.coalesce("dst_ip", "arp_dst_ip"),
            "src_port": F.coalesce("tcp_src_port", "udp_src_port"),
            "dst_port": F.coalesce("tcp_dst_port", "udp_dst_port"),
            "length": F.col("__size"),
            "identification": F.col("ip_id"),
            "tcp_flags": flag_names(F.col("tcp_flags_mask")),
            "udp_checksum": hex_text(F.col("udp_checksum_value")),
            "http_path": F.coalesce("http_path", "http_raw"),
        }
    )
    directed = named.withColumn(
        "packet_direction", packet_direction(F.col("protocol"), F.col("src_ip"), F.col("dst_ip"))
    )
    return with_arp_name(with_snmp_name(with_dhcp_name(_unstage(directed)))).select(*ROW_COLUMNS)


ROW_COLUMNS = [
    "packet_id", "ts", "src_mac", "dst_mac", "src_ip", "dst_ip", "src_port", "dst_port",
    "protocol", "length", "ttl", "tcp_flags", "tcp_flags_mask", "tcp_window", "icmp_type",
    "icmp_code", "dns_query", "http_method", "http_host", "http_path", "packet_direction",
    "ip_proto", "identification", "udp_length", "udp_checksum", "http_status", "dns_id",
    "dns_qr", "dns_opcode", "dns_qtype", "dns_ans_name", "dns_ans_rdata", "dns_ans_type",
    "arp_opcode", "arp_src_mac", "arp_src_ip", "arp_dst_mac", "arp_dst_ip", "dhcp_type",
    "snmp_community", "snmp_pdu", "snmp_request_id", "snmp_oid", "snmp_value",
    "tls_content_type", "tls_version", "tls_handshake_type",
]
