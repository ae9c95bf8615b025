"""Address tests and traffic direction, all as native expressions."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetscope.constants import PRIVATE_V6, PUBLIC_V6_EXCEPTIONS
from packetscope.functions.text import any_of, flag

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"^{_OCTET}(\.{_OCTET}){{3}}\z"
_V4_TAIL = rf":{_OCTET}(\.{_OCTET}){{3}}\z"
_PREFIX = r"^(10\.|127\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)"

# A well-formed address that starts like one of the reserved ranges; two single
# addresses of 192.0.0.0/24 are public.
_RESERVED_V4 = rf"^(?={_OCTET}(\.{_OCTET}){{3}}\z)(?:" + "|".join(
    [
        r"(0|10|127|24\d|25[0-5])\.",
        r"169\.254\.",
        r"172\.(1[6-9]|2\d|3[01])\.",
        r"192\.168\.",
        r"192\.0\.2\.",
        r"192\.0\.0\.(?!(9|10)\z)",
        r"198\.1[89]\.",
        r"198\.51\.100\.",
        r"203\.0\.113\.",
    ]
) + ")"

_NO_GROUPS = "array<string>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ipv4_number(ip: Column) -> Column:
    """The address as BIGINT; NULL when the text is no dotted IPv4 address."""
    parts = [F.split_part(ip, F.lit("."), F.lit(i)).cast("bigint") for i in (1, 2, 3, 4)]
    value = ((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3]
    return F.when(ip.rlike(_V4), value)


def _dotted_tail_as_groups(text: Column) -> Column:
    """``::ffff:10.0.0.1`` with its last part as two ordinary groups."""
    tail = F.regexp_extract(text, r"(\d+\.\d+\.\d+\.\d+)\z", 1)
    head = F.regexp_replace(text, r"\d+\.\d+\.\d+\.\d+\z", "")
    digits = F.lpad(F.lower(F.hex(ipv4_number(tail))), 8, "0")
    grouped = F.concat(head, F.regexp_replace(digits, "^(....)", "$1:"))
    return F.when(text.rlike(_V4_TAIL), grouped).otherwise(text)


def _groups(half: Column) -> Column:
    none = F.array().cast(_NO_GROUPS)
    return F.when(F.coalesce(half, F.lit("")) == "", none).otherwise(F.split(half, ":"))


def _all_groups(halves: Column) -> Column:
    """The eight groups of an address split at ``::``; another number of groups if it is wrong."""
    left, right = _groups(F.get(halves, F.lit(0))), _groups(F.get(halves, F.lit(1)))
    gap = F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right))
    return (
        F.when(F.size(halves) == 1, left)
        .when((F.size(halves) == 2) & (F.size(gap) > 0), F.concat(left, gap, right))
        .otherwise(F.array().cast(_NO_GROUPS))
    )


def _digits(groups: Column) -> Column:
    padded = F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")
    sound = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike(r"^[0-9a-f]{1,4}\z"))
    return F.when(sound, padded)


def ipv6_hex(ip: Column) -> Column:
    """The address as 32 hex digits; NULL when the text is no IPv6 address."""
    text = F.lower(F.split_part(ip, F.lit("%"), F.lit(1)))
    plain = _let(text, _dotted_tail_as_groups)
    return _let(_let(F.split(plain, "::"), _all_groups), _digits)


def _in_networks(digits: Column, networks: list[tuple[str, int]]) -> Column:
    tests = []
    for prefix, bits in networks:
        net = ipaddress.IPv6Network(f"{prefix}/{bits}")
        first = f"{int(net.network_address):032x}"
        last = f"{int(net.broadcast_address):032x}"
        tests.append(digits.between(first, last))
    return any_of(tests)


def _dotted(digits: Column) -> Column:
    """The IPv4 address in the last eight hex digits."""
    octets = [F.conv(F.substring(digits, 25 + 2 * i, 2), 16, 10) for i in range(4)]
    return F.concat_ws(".", *octets)


def _reserved_v6(digits: Column) -> Column:
    """Listed networks; an address that wraps an IPv4 one is judged by that."""
    wraps_v4 = digits.startswith("0" * 20 + "ffff")
    listed = _in_networks(digits, PRIVATE_V6) & ~_in_networks(digits, PUBLIC_V6_EXCEPTIONS)
    return F.when(wraps_v4, _dotted(digits).rlike(_RESERVED_V4)).otherwise(listed)


def private_registry(ip: Column) -> Column:
    """1 for an address the public registries reserve, 0 for any other or no address."""
    v6 = _let(ipv6_hex(ip), _reserved_v6)
    return flag(F.when(ip.contains(":"), v6).otherwise(ip.rlike(_RESERVED_V4)))


def private_prefix(ip: Column) -> Column:
    """1 for 10/8, 127/8, 172.16/12 and 192.168/16 judged by how the text starts."""
    return flag(ip.rlike(_PREFIX))


def direction(src_ip: Column, dst_ip: Column) -> Column:
    """Outbound, Inbound, Local or External; Unknown without any address."""
    src, dst = private_prefix(src_ip) == 1, private_prefix(dst_ip) == 1
    return (
        F.when(src_ip.isNull() & dst_ip.isNull(), F.lit("Unknown"))
        .when(src & dst, F.lit("Local"))
        .when(src, F.lit("Outbound"))
        .when(dst, F.lit("Inbound"))
        .otherwise(F.lit("External"))
    )


def arp_direction(dst_ip: Column) -> Column:
    return F.when(dst_ip == "255.255.255.255", F.lit("Broadcast")).otherwise(F.lit("Local"))


def packet_direction(protocol: Column, src_ip: Column, dst_ip: Column) -> Column:
    """Direction as the packet writers record it: ARP by its target, the rest by address."""
    return F.when(protocol == "ARP", arp_direction(dst_ip)).otherwise(direction(src_ip, dst_ip))


def frame_direction(
    protocol: Column, arp_opcode: Column, src_ip: Column, dst_ip: Column, dst_mac: Column
) -> Column:
    """Direction as recorded from raw frames: ARP by opcode, non-IP by target hardware address."""
    return (
        F.when(
            protocol == "ARP",
            F.when(arp_opcode == "request", F.lit("Request"))
            .when(arp_opcode == "reply", F.lit("Reply"))
            .otherwise(F.lit("Unknown")),
        )
        .when(src_ip.isNotNull() | dst_ip.isNotNull(), direction(src_ip, dst_ip))
        .when(dst_mac.startswith("ff:ff:ff"), F.lit("Broadcast"))
        .otherwise(F.lit("Unknown"))
    )


def network_context(src_ip: Column, dst_ip: Column) -> Column:
    """Who talks to whom, for packets that carry both addresses."""
    src, dst = private_prefix(src_ip) == 1, private_prefix(dst_ip) == 1
    return F.when(
        src_ip.isNotNull() & dst_ip.isNotNull(),
        F.when(src & dst, F.lit("internal"))
        .when(src, F.lit("internal_to_external"))
        .when(dst, F.lit("external_to_internal"))
        .otherwise(F.lit("external")),
    )


def mac_text(raw: Column) -> Column:
    """``02:00:...`` for a binary hardware address."""
    return F.regexp_replace(F.lower(F.hex(raw)), "(..)(?!$)", "$1:")
