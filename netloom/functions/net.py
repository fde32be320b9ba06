"""Address arithmetic and network predicates as Column expressions."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_GROUP = "[0-9a-fA-F]{1,4}"
_IPV6 = (
    rf"^(({_GROUP}:){{7}}{_GROUP}"
    rf"|(?=.*::)(?!.*::.*::)(?!.*:::)(?!:[^:])(?!.*[^:]:$)(:|{_GROUP}:|:){{1,7}}({_GROUP}|:)?)(%.+)?$"
)

# The ranges a block command must never touch.
PRIVATE_NETS = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8"]

# TCP flag bits.
TCP_FLAG_BITS = {"fin": 0x01, "syn": 0x02, "rst": 0x04, "psh": 0x08, "ack": 0x10, "urg": 0x20}


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(_IPV4), F.lit(False))


def ipv4_number(ip: Column) -> Column:
    """Dotted quad as bigint; NULL for anything else."""
    part = [F.split_part(ip, F.lit("."), F.lit(i)).cast("long") for i in (1, 2, 3, 4)]
    value = part[0] * 16777216 + part[1] * 65536 + part[2] * 256 + part[3]
    return F.when(is_ipv4(ip), value)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _groups_only(ip: Column) -> Column:
    """IPv6 text whose last four bytes, if written as a dotted quad, are two groups like the others."""
    quad = F.regexp_extract(ip, r":([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)(%.+)?$", 1)
    head = F.substr(ip, F.lit(1), F.char_length(ip) - F.char_length(F.substring_index(ip, ":", -1)))  # all before the quad
    written = lambda n: F.when(n.isNotNull(), F.concat(head, F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(0xFFFF))))).otherwise(ip)
    return F.when(ip.contains("."), _let(_let(quad, ipv4_number), written)).otherwise(ip)


def is_ip(ip: Column) -> Column:
    return F.coalesce(ip.rlike(_IPV4) | F.when(ip.contains(":"), _groups_only(ip).rlike(_IPV6)), F.lit(False))


def ip_parts(ip: Column) -> Column:
    """struct(family, hi, lo): 4 or 6, and the address as 128 bits in two signed halves; NULL for anything else.

    An IPv4 address has its number in ``lo``. A zone (``%eth0``) plays no part.
    """
    def halves(groups: Column) -> Column:
        half = lambda at: F.aggregate(F.slice(groups, at, 4), F.lit(0).cast("long"), lambda v, g: F.shiftleft(v, 16).bitwiseOR(g))
        return F.when(F.size(groups) == 8, F.struct(F.lit(6).alias("family"), half(1).alias("hi"), half(5).alias("lo")))

    def parsed(text: Column) -> Column:
        filled = lambda at: F.filter(F.split(F.split_part(text, F.lit("::"), F.lit(at)), ":"), lambda g: g != "")
        zeros = lambda sides: F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(sides["l"]) - F.size(sides["r"]), F.lit(0)))
        whole = lambda sides: F.transform(F.concat(sides["l"], zeros(sides), sides["r"]), lambda g: F.conv(g, 16, 10).cast("long"))
        sides = F.struct(filled(1).alias("l"), filled(2).alias("r"))
        return F.when(text.rlike(_IPV6), _let(_let(sides, whole), halves))

    six = F.when(ip.contains(":"), _let(F.lower(F.split_part(_groups_only(ip), F.lit("%"), F.lit(1))), parsed))
    four = lambda n: F.when(n.isNotNull(), F.struct(F.lit(4).alias("family"), F.lit(0).cast("long").alias("hi"), n.alias("lo")))
    return F.coalesce(_let(ipv4_number(ip), four), six)


def masked(parts: Column, length: Column) -> Column:
    """struct(hi, lo) of an address with only the first ``length`` bits of its family left (32 or 128)."""
    bits = length + F.when(parts["family"] == 4, 96).otherwise(0)
    mask = lambda n: F.when(n <= 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(-1).cast("long"), F.greatest(F.lit(64) - n, F.lit(0)).cast("int")))
    return F.struct(parts["hi"].bitwiseAND(mask(F.least(bits, F.lit(64)))).alias("hi"), parts["lo"].bitwiseAND(mask(bits - 64)).alias("lo"))


def network_parts(cidr: Column) -> Column:
    """struct(family, length, hi, lo) of ``address/length`` (a bare address has all its bits); NULL when malformed or when host bits are set."""
    tail = F.split_part(cidr, F.lit("/"), F.lit(2))

    def with_length(address: Column) -> Column:
        most = F.when(address["family"] == 4, 32).otherwise(128)
        return F.struct(address.alias("a"), F.when(tail == "", most).otherwise(tail.try_cast("int")).alias("length"), most.alias("most"))

    def checked(x: Column) -> Column:
        same = lambda low: (low["hi"] == x["a"]["hi"]) & (low["lo"] == x["a"]["lo"])
        good = x["length"].between(0, x["most"]) & _let(masked(x["a"], x["length"]), same)
        return F.when(good, F.struct(x["a"]["family"].alias("family"), x["length"].alias("length"), x["a"]["hi"].alias("hi"), x["a"]["lo"].alias("lo")))

    return _let(_let(ip_parts(F.split_part(cidr, F.lit("/"), F.lit(1))), with_length), checked)


def ipv4_ranges(nets: Iterable[str]) -> list[tuple[int, int]]:
    """Bounds of the IPv4 networks in ``nets``; raises ValueError when any entry is malformed."""
    parsed = [ipaddress.ip_network(n) for n in nets]
    return [(int(n.network_address), int(n.broadcast_address)) for n in parsed if n.version == 4]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def ipv6_networks(nets: Iterable[str]) -> list[tuple[int, int, int]]:
    """(length, hi, lo) of the IPv6 networks in ``nets``."""
    parsed = [ipaddress.ip_network(n) for n in nets]
    return [(n.prefixlen, _signed(int(n.network_address) >> 64), _signed(int(n.network_address) & (1 << 64) - 1)) for n in parsed if n.version == 6]


def in_ranges(number: Column, ranges: list[tuple[int, int]]) -> Column:
    tests = [number.between(F.lit(lo), F.lit(hi)) for lo, hi in ranges]
    hit = reduce(lambda a, b: a | b, tests, F.lit(False))
    return F.coalesce(hit, F.lit(False))


def cidr_low(cidr: Column) -> Column:
    """First address of an IPv4 ``a.b.c.d/len`` string; a bare address counts as /32.

    NULL when malformed or when host bits are set.
    """
    low = ipv4_number(F.split_part(cidr, F.lit("/"), F.lit(1)))
    size = prefix_size(cidr_length(cidr))
    return F.when(F.pmod(low, size) == 0, low)


def cidr_length(cidr: Column) -> Column:
    tail = F.split_part(cidr, F.lit("/"), F.lit(2))
    length = F.when(tail == "", F.lit(32)).otherwise(tail.try_cast("int"))
    return F.when(length.between(0, 32), length)


def prefix_size(length: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(32) - length)


def with_direction(df: DataFrame, home_nets: Iterable[str], src: str = "_src_ip", dst: str = "_dst_ip") -> DataFrame:
    """Adds ``direction``: outbound / inbound / internal / external, or uncertain when it cannot be told.

    No home networks, a malformed one, or an address that is none make it uncertain. Each address is
    parsed once, in a projection of its own.
    """
    nets = list(home_nets or [])
    try:
        ranges, six = ipv4_ranges(nets), ipv6_networks(nets)
    except ValueError:
        nets = []
    if not nets:
        return df.withColumn("direction", F.lit("uncertain"))
    parsed = df.withColumns({"_s_num": ipv4_number(F.col(src)), "_d_num": ipv4_number(F.col(dst))})
    if six:
        parsed = parsed.withColumns({"_s_parts": ip_parts(F.col(src)), "_d_parts": ip_parts(F.col(dst))})

    def at_home(number, parts):
        home = in_ranges(F.col(number), ranges)
        for length, hi, lo in six:
            low = masked(F.col(parts), F.lit(length))
            home = home | F.coalesce((F.col(parts)["family"] == 6) & (low["hi"] == hi) & (low["lo"] == lo), F.lit(False))
        return home.cast("int")

    def known(name, number):
        return F.col(number).isNotNull() | is_ip(F.col(name))

    side = at_home("_s_num", "_s_parts") * 2 + at_home("_d_num", "_d_parts")
    told = F.element_at(F.array(*[F.lit(d) for d in ("external", "inbound", "outbound", "internal")]), side + 1)
    direction = F.when(known(src, "_s_num") & known(dst, "_d_num"), told).otherwise("uncertain")
    return parsed.withColumn("direction", direction).drop("_s_num", "_d_num", "_s_parts", "_d_parts")


def is_blockable(ip: Column) -> Column:
    """True for a valid address outside the private and loopback ranges."""
    return is_ip(ip) & ~in_ranges(ipv4_number(ip), ipv4_ranges(PRIVATE_NETS))


def skips_enrichment(ip: Column) -> Column:
    """Addresses never looked up in intel tables; 172.16/12 is looked up on purpose."""
    return (
        ip.isNull() | (ip == "") | ip.startswith("192.168.") | ip.startswith("10.") | (ip == "127.0.0.1")
    )


def flag_bit(flags: Column, name: str) -> Column:
    return (flags.bitwiseAND(F.lit(TCP_FLAG_BITS[name])) != 0).cast("int")
