"""Packets to frame bytes, written as native expressions in the hex-text domain.

Headers and payloads are put together as hex digits and turned into binary once,
so the whole job stays in generated code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetscope.operators.lookups import transport_of
from packetscope.plans.staged import computed_once

_EMPTY = ""
# no hex digit: bytes with it in their text cannot be made, so the frame is NULL
_BAD = "!"


def packed(*fields: tuple[str, int], known: bool = False) -> Column:
    """Big-endian hex digits of neighbouring numbers, seven bytes at most.

    Fields are (SQL of the value, octets). NULL is 0; a value its field cannot hold spoils
    the frame, unless all are ``known`` to fit. One conversion serves all of them.
    """
    total, width, fits = "", 0, []
    for value, octets in reversed(fields):
        number = f"coalesce(try_cast({value} AS BIGINT), 0L)"
        if not known and not value.isdigit():
            fits.append(f"{number} BETWEEN 0 AND {(1 << (8 * octets)) - 1}L")
        total += (" | " if total else "") + f"shiftleft({number}, {8 * width})"
        width += octets
    digits = f"lpad(hex({total}), {2 * width}, '0')"
    return F.expr(f"CASE WHEN {' AND '.join(fits)} THEN {digits} ELSE '{_BAD}' END" if fits else digits)


def low_bits(column: str, octets: int) -> str:
    """SQL of a counter that starts again at 0 when its field is full, such as a packet id."""
    return f"({column} & {(1 << (8 * octets)) - 1}L)"


def number_hex(value: str, octets: int) -> Column:
    return packed((value, octets))


def _const(digits: str) -> Column:
    return F.lit(digits)


def mac_hex(mac: str) -> Column:
    return F.expr(f"upper(replace(coalesce({mac}, '00:00:00:00:00:00'), ':', ''))")


def ip_hex(ip: str) -> Column:
    """Four octets of a dotted address; none is 0.0.0.0, any other text gives NULL."""
    octets = packed(*[(f"split_part({ip}, '.', {i})", 1) for i in (1, 2, 3, 4)], known=True)
    octet = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    dotted = F.expr(f"coalesce({ip}, '') = '' OR {ip} RLIKE '^{octet}([.]{octet}){{3}}$'")
    return F.when(dotted, octets)


def _closed(ip: str) -> Column:
    """Lower-case IPv6 text without zone and dotted tail; a gap at an end gets the zero beside it."""
    text = f"lower(split_part({ip}, '%', 1))"
    tail = packed(
        *[(f"split_part(regexp_extract({text}, '[0-9.]+$', 0), '.', {i})", 1) for i in (1, 2, 3, 4)], known=True
    )
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    dotted = F.lower(F.regexp_replace(tail, "^(....)", "$1:"))
    plain = F.when(
        F.expr(f"{text} RLIKE ':{octet}([.]{octet}){{3}}$'"),
        F.concat(F.regexp_replace(F.expr(text), "[0-9.]+$", ""), dotted),
    ).otherwise(F.expr(text))
    return F.regexp_replace(F.regexp_replace(plain, "^::", "0::"), "::$", "::0")


def _expanded(closed: Column) -> Column:
    """Thirty-two digits; as many groups stand for a gap as there are fewer than eight colons."""
    colons = F.length(closed) - F.length(F.replace(closed, F.lit(":"), F.lit("")))
    gap = F.concat(F.lit(":"), F.repeat(F.lit("0:"), F.lit(8) - colons))
    whole = F.when(
        closed.rlike("^[^:]+(:[^:]+)*::[^:]+(:[^:]+)*$") & (colons < 8), F.replace(closed, F.lit("::"), gap)
    ).otherwise(closed)
    padded = F.regexp_replace(F.concat(whole, F.lit(":")), "([^:]+):", "000$1:")
    digits = F.regexp_replace(padded, "[0-9a-f]{0,3}([0-9a-f]{4}):", "$1")
    sound = padded.rlike("^(000[0-9a-f]{1,4}:){8}$")
    return F.when(sound, F.upper(digits))


def ip6_hex(ip: str) -> Column:
    """Thirty-two digits of an IPv6 address; NULL for text that is none. A zone is left out."""
    return _let(_closed(ip), _expanded)


def text_hex(text: Column) -> Column:
    return F.hex(text.cast("string"))


def _sized(body: Column, octets: int, most: int | None = None) -> Column:
    """Length prefix and body, both as hex; a body over ``most`` bytes spoils the frame."""
    size = (F.length(body) / 2).cast("bigint")
    prefix = F.lpad(F.hex(size), 2 * octets, "0")
    fits = size <= F.lit((1 << (8 * octets)) - 1 if most is None else most)
    return F.when(fits, F.concat(prefix, body)).otherwise(F.lit(_BAD))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, written down once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _tlv(tag: str | Column, body: Column) -> Column:
    """BER element; bodies of 128 bytes and more take the long form of the length."""

    def element(digits: Column) -> Column:
        size = (F.length(digits) / 2).cast("bigint")
        octets = F.when(size < 256, 1).when(size < 65536, 2).otherwise(3)
        long = F.concat(F.hex(octets + 128), F.lpad(F.hex(size), octets * 2, F.lit("0")))
        short = F.lpad(F.hex(size), 2, "0")
        head = _const(tag) if isinstance(tag, str) else tag
        return F.concat(head, F.when(size < 128, short).otherwise(long), digits)

    return _let(body, element)


def dns_name_hex(name: Column) -> Column:
    """Labels with their lengths; one over 63 bytes or a name over 255 spoils the frame."""
    labels = F.filter(F.split(name, r"\."), lambda x: x != "")
    parts = F.transform(labels, lambda x: _sized(text_hex(x), 1, 63))
    whole = F.concat(F.array_join(parts, ""), _const("00"))
    return _let(whole, lambda w: F.when(F.length(w) > 510, F.lit(_BAD)).otherwise(w))


def http_payload(columns: list[str]) -> Column:
    """Request text when there is a method, else a status line, or a mid-stream line for raw HTTP."""
    request = F.concat(
        F.col("http_method"),
        F.lit(" "),
        F.col("http_path"),
        F.lit(" HTTP/1.1\r\nHost: "),
        F.coalesce(F.col("http_host"), F.lit("")),
        F.lit("\r\n\r\n"),
    )
    if "http_status" in columns:
        head = F.concat(F.lit("HTTP/1.1 "), F.col("http_status").cast("string"))
        response = F.concat(head, F.lit(" \r\nContent-Length: 0\r\n\r\n"))
        request = F.coalesce(request, F.when(F.col("http_method").isNull(), response))
    raw = F.concat(F.lit(".. GET /part/"), F.col("packet_id").cast("string"), F.lit("\r\nrest"))
    return F.when(F.col("protocol") == "HTTP", text_hex(request)).when(
        F.col("protocol") == "HTTP (Raw)", text_hex(raw)
    )


def _dns_answer() -> Column:
    """One record; its name points back at the question where it is the same.

    Data are an address for types 1 and 28, a name for 2, 5 and 12, text for others.
    """
    kind, data = F.col("dns_ans_type"), F.col("dns_ans_rdata")
    same = F.col("dns_ans_name") == F.col("dns_query")
    body = (
        F.when(kind == 1, F.coalesce(ip_hex("dns_ans_rdata"), F.lit(_BAD)))
        .when(kind == 28, F.coalesce(ip6_hex("dns_ans_rdata"), F.lit(_BAD)))
        .when(kind.isin(2, 5, 12), dns_name_hex(data))
        .otherwise(text_hex(F.coalesce(data, F.lit(""))))
    )
    return F.concat(
        F.when(same, _const("C00C")).otherwise(dns_name_hex(F.col("dns_ans_name"))),
        number_hex("dns_ans_type", 2),
        _const("0001" "0000003C"),
        _let(body, lambda b: _sized(b, 2)),
    )


def dns_payload(columns: list[str]) -> Column:
    """One question, and one answer when the packet has it."""
    query, answer = _const("0100" "0001" "0000" "0000" "0000"), _const("")
    if "dns_ans_name" in columns:
        answered = F.col("dns_ans_name").isNotNull()
        query = F.when(answered, _const("8180" "0001" "0001" "0000" "0000")).otherwise(query)
        answer = F.when(answered, _dns_answer()).otherwise(answer)
    return F.concat(
        number_hex(low_bits("packet_id", 2), 2),
        query,
        dns_name_hex(F.col("dns_query")),
        number_hex("dns_qtype", 2),
        _const("0001"),
        answer,
    )


def dhcp_payload() -> Column:
    """Fixed part (236 bytes, mostly empty), cookie, message type option, end."""
    return F.concat(
        _const("01010600"),
        number_hex(low_bits("packet_id", 4), 4),
        F.repeat(F.lit("00"), 228),
        _const("63825363" "3501"),
        number_hex("dhcp_type_code", 1),
        _const("FF"),
    )


def snmp_payload() -> Column:
    """Version 2c message with one NULL-free variable binding: sysDescr.0 = text."""
    oid = _tlv("06", _const("2B06010201010100"))
    value = _tlv("04", text_hex(F.concat(F.lit("v"), F.col("packet_id").cast("string"))))
    bindings = _tlv("30", _tlv("30", F.concat(oid, value)))
    pdu_body = F.concat(
        _tlv("02", number_hex("(packet_id & 2147483647L)", 4)), _const("020100"), _const("020100"), bindings
    )
    pdu = _tlv(number_hex("160 + snmp_pdu_code", 1), pdu_body)
    return _tlv("30", F.concat(_const("020101"), _tlv("04", text_hex(F.lit("public"))), pdu))


def tls_payload() -> Column:
    """Record header, then the handshake type or two bytes of cover text."""
    handshake = F.concat(number_hex("tls_handshake_type", 1), _const("000000"))
    body = F.when(F.col("tls_handshake_type").isNotNull(), handshake).otherwise(_const("FFFF"))
    return F.concat(
        number_hex("tls_content_type", 1), number_hex("tls_version", 2), _sized(body, 2)
    )


def _payload(columns: list[str]) -> Column:
    protocol = F.col("protocol")
    chosen = (
        F.when(protocol.isin("HTTP", "HTTP (Raw)"), http_payload(columns))
        .when(protocol == "TLS", tls_payload())
        .when(protocol == "DNS", dns_payload(columns))
        .when(protocol == "DHCP", dhcp_payload())
        .when(protocol == "SNMP", snmp_payload())
    )
    return F.coalesce(chosen, F.lit(_EMPTY))


def _ports() -> Column:
    return packed(("src_port", 2), ("dst_port", 2))


def tcp_header() -> Column:
    """Ports, sequence and acknowledgement 1, 20 bytes, bits, window; checksum to be filled in."""
    bits = packed(("80", 1), ("tcp_flags_mask", 1), ("tcp_window", 2))
    return F.concat(_ports(), _const("00000001" "00000001"), bits, _const("0000" "0000"))


def udp_header() -> Column:
    """Ports, length of header and payload; checksum to be filled in."""
    return F.concat(_ports(), packed(("length(__p) / 2 + 8", 2), ("0", 2)))


def icmp_header() -> Column:
    kind = packed(("icmp_type", 1), ("icmp_code", 1))
    return F.concat(kind, _const("0000" "00010001"))


def ipv4_header() -> Column:
    """20-byte header: don't-fragment set, id from the packet number, no checksum."""
    number = "CASE __t WHEN 'TCP' THEN 6 WHEN 'UDP' THEN 17 ELSE 1 END"
    return F.concat(
        packed(("17664", 2), ("length(__b) / 2 + 20", 2), (low_bits("packet_id", 2), 2)),
        packed(("16384", 2), ("ttl", 1), (number, 1), ("0", 2)),
        F.col("__src_ip"),
        F.col("__dst_ip"),
    )


_NEXT = "CASE __t WHEN 'TCP' THEN 6 WHEN 'UDP' THEN 17 ELSE 58 END"
# digits before the checksum in each transport header
_BEFORE = "CASE __t WHEN 'TCP' THEN 32 WHEN 'UDP' THEN 12 ELSE 4 END"


def ipv6_header() -> Column:
    """40-byte header without extensions; the payload's length has 16 bits."""
    return F.concat(
        _const("60000000"),
        packed(("length(__b) / 2", 2), (_NEXT, 1), ("ttl", 1)),
        F.col("__src_ip"),
        F.col("__dst_ip"),
    )


def _ipv6_checksum() -> Column:
    """Internet checksum of pseudo-header and transport part, four hex digits.

    IPv6 headers have none of their own, so TCP, UDP and ICMPv6 must carry it. A sum that
    comes out as 0 is sent as FFFF, since 0 means "none" in UDP.
    """
    pseudo = F.concat("__src_ip", "__dst_ip", packed(("length(__b) / 2", 4)), packed((_NEXT, 4)))
    padded = F.concat(pseudo, F.col("__b"), F.repeat(F.lit("00"), (F.length("__b") / 2).cast("int") % 2))

    def folded(raw: Column) -> Column:
        words = F.sequence(F.lit(1), F.octet_length(raw), F.lit(2))
        total = F.aggregate(
            words,
            F.lit(0).cast("bigint"),
            lambda s, at: s + F.conv(F.hex(F.substring(raw, at, F.lit(2))), 16, 10).cast("bigint"),
        )
        return _let(total, _complement)

    return _let(F.unhex(padded), folded)


def _complement(total: Column) -> Column:
    """Fold the carries into 16 bits (twice, for one may come up again) and invert."""
    once = total.bitwiseAND(F.lit(0xFFFF)) + F.shiftright(total, 16)
    twice = once.bitwiseAND(F.lit(0xFFFF)) + F.shiftright(once, 16)
    sent = F.when(twice == 0xFFFF, F.lit(0xFFFF).cast("bigint")).otherwise(F.lit(0xFFFF) - twice)
    return F.lpad(F.hex(sent), 4, "0")


def arp_body() -> Column:
    """Request (1) or reply (2) between the packet's own addresses."""
    opcode = F.when(F.col("arp_opcode") == "request", _const("0001")).otherwise(_const("0002"))
    return F.concat(
        _const("0001" "0800" "06" "04"),
        opcode,
        F.col("__src_mac"),
        F.col("__src_ip"),
        F.col("__dst_mac"),
        F.col("__dst_ip"),
    )


def _addresses(df: DataFrame) -> DataFrame:
    """Add ``__src_ip`` and ``__dst_ip``: digits of IPv4 or IPv6 addresses, NULL for other text."""
    closed = {f"__{c}6": F.when(F.col(c).contains(":"), _closed(c)) for c in ("src_ip", "dst_ip")}
    digits = {
        f"__{c}": F.when(F.col(f"__{c}6").isNotNull(), _expanded(F.col(f"__{c}6"))).otherwise(ip_hex(c))
        for c in ("src_ip", "dst_ip")
    }
    return computed_once(computed_once(df, closed), digits).drop(*closed)


def with_frame(df: DataFrame, wrap: tuple[str, ...] = ()) -> DataFrame:
    """Add ``frame``: Ethernet bytes of each packet.

    Packets between two IPv6 addresses get an IPv6 header and a transport checksum, others
    an IPv4 header without one. The frame is NULL where an address is neither, the two are
    of different kinds, ARP is asked for IPv6 addresses, or a field cannot hold its value:
    ports, window, time-to-live, lengths, DNS labels. Columns named in ``wrap`` are reduced
    to their low 16 bits instead. Ids made from ``packet_id`` start again when they are full.
    """
    transport = transport_of(F.col("protocol"))
    cut = df.withColumns({f"__was_{c}": F.col(c) for c in wrap}).withColumns(
        {c: F.col(c).bitwiseAND(F.lit(0xFFFF)) for c in wrap}
    )
    macs = {"__src_mac": mac_hex("src_mac"), "__dst_mac": mac_hex("dst_mac")}
    staged = computed_once(computed_once(_addresses(cut), macs), {"__t": transport, "__p": _payload(df.columns)})
    body = (
        F.when(F.col("__t") == "TCP", F.concat(tcp_header(), F.col("__p")))
        .when(F.col("__t") == "UDP", F.concat(udp_header(), F.col("__p")))
        .when(F.col("__t") == "ICMP", icmp_header())
        .otherwise(F.lit(_EMPTY))
    )
    staged = computed_once(staged, {"__b": body})
    is_v6 = (F.length("__src_ip") + F.length("__dst_ip") == 64) & (F.col("protocol") != "ARP")
    # a stage of its own, so that the others stay in generated code
    staged = computed_once(staged, {"__sum": F.when(is_v6 & (F.col("__b") != ""), _ipv6_checksum())})
    is_arp = F.col("protocol") == "ARP"
    lengths = F.length("__src_ip") + F.length("__dst_ip")
    before = F.expr(_BEFORE)
    summed = F.when(F.col("__b") == "", F.lit("")).otherwise(
        F.concat(
            F.substring(F.col("__b"), F.lit(1), before),
            F.col("__sum"),
            F.substring(F.col("__b"), before + 5, F.length("__b")),
        )
    )
    digits = (
        F.when(
            is_arp & (lengths == 16), F.concat(_const("0806"), arp_body())
        )
        .when(~is_arp & (lengths == 16), F.concat(_const("0800"), ipv4_header(), F.col("__b")))
        .when(is_v6, F.concat(_const("86DD"), ipv6_header(), summed))
    )
    made = computed_once(
        staged, {"frame": F.unhex(F.concat(F.col("__dst_mac"), F.col("__src_mac"), digits))}
    )
    whole = made.withColumns({c: F.col(f"__was_{c}") for c in wrap})
    return whole.drop("__t", "__p", "__b", "__sum", "__src_ip", "__dst_ip", *macs, *[f"__was_{c}" for c in wrap])


def frames(df: DataFrame, wrap: tuple[str, ...] = ("tcp_window",)) -> DataFrame:
    """(packet_id, ts, frame) of canonical packets.

    Captures hold windows already multiplied by their scale; a segment carries 16 bits of
    them, here the low ones. With an empty ``wrap`` such frames are NULL.
    """
    return with_frame(df, wrap).select("packet_id", "ts", "frame")


def with_vlan_tag(df: DataFrame, tpid: Column, vlan_id: Column, when: Column) -> DataFrame:
    """Put an 802.1Q or 802.1ad tag before the outermost type of the frames ``when`` chooses.

    ``tpid`` is the tag's type, 0x8100 or 0x88A8; an id outside 0 to 4095 makes the frame NULL.
    """
    digits = F.concat(F.lpad(F.hex(tpid), 4, "0"), F.lpad(F.hex(vlan_id), 4, "0"))
    tag = F.when(vlan_id.between(0, 4095), digits)
    frame = F.col("frame")
    tagged = F.concat(
        F.substring(frame, 1, 12), F.unhex(tag), F.substring(frame, F.lit(13), F.octet_length(frame))
    )
    return df.withColumn("frame", F.when(when, tagged).otherwise(frame))


def parse_raw_data(text: Column) -> Column:
    """Bytes of a saved ``raw_data`` field.

    ``[1, 255, ...]`` with every number in 0..255 is a byte list; any other text
    stands for its own character codes (one byte each up to U+00FF, else UTF-8).
    """
    numbers = F.from_json(text, "array<int>")
    is_list = text.rlike(r"^\[\s*(\d+(\s*,\s*\d+)*)?\s*\]$") & F.coalesce(
        F.forall(numbers, lambda n: n.between(0, 255)), F.lit(False)
    )
    listed = F.unhex(F.array_join(F.transform(numbers, lambda n: F.lpad(F.hex(n), 2, "0")), ""))
    one_byte = text.rlike("^[\\u0000-\\u00ff]*$")
    codes = F.when(one_byte, F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    return F.when(is_list, listed).when(text != "", codes)


def byte_list_text(raw: Column) -> Column:
    """``[1, 255, ...]`` for a binary column; the inverse of :func:`parse_raw_data`."""
    positions = F.sequence(F.lit(1), F.octet_length(raw))
    numbers = F.transform(
        positions, lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10)
    )
    joined = F.when(F.octet_length(raw) > 0, F.array_join(numbers, ", ")).otherwise(F.lit(""))
    return F.concat(F.lit("["), joined, F.lit("]"))


def hex_dump(df: DataFrame, raw: str = "frame") -> DataFrame:
    """(packet_id, byte_offset, hex, ascii): 16 bytes a row, unprintable bytes as dots."""
    size = F.octet_length(raw)
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(16)))
    rows = df.select("packet_id", F.col(raw).alias("__raw"), F.explode(starts).alias("byte_offset"))
    piece = F.substring(F.col("__raw"), F.col("byte_offset") + 1, F.lit(16))
    rows = rows.select("packet_id", "byte_offset", piece.alias("__piece"))
    latin = F.decode("__piece", "ISO-8859-1")
    return rows.select(
        "packet_id",
        "byte_offset",
        F.trim(F.regexp_replace(F.lower(F.hex("__piece")), "(..)", "$1 ")).alias("hex"),
        F.regexp_replace(latin, "[^ -~]", ".").alias("ascii"),
    )
