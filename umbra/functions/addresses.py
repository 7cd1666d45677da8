"""IPv4, MAC and AS-number recognition, classification and rendering as Catalyst expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbra.functions.digests import keyed, low_bits, modulo, tag
from umbra.functions.rewrite import let
from umbra.plans import rulebook as book

JAVA = "(?U)"


def ipv4_candidates(text: Column) -> Column:
    """All dotted quads of a text; Unicode letters bound words."""
    return F.regexp_extract_all(text, F.lit(JAVA + book.IPV4), F.lit(1))


def ipv4_number(quad: Column) -> Column:
    """The address as a number; null unless each octet is 0 to 255 without leading zeros."""
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    valid = quad.rlike(rf"^{octet}(\.{octet}){{3}}$")
    parts = F.split(quad, r"\.")
    number = sum((F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0).cast("bigint"))
    return F.when(valid, number)


def ipv4_text(number: Column) -> Column:
    return F.concat_ws(".", *[(F.shiftright(number, 24 - 8 * i).bitwiseAND(F.lit(255))).cast("string") for i in range(4)])


def mask_like(number: Column) -> Column:
    """Contiguous netmasks and wildcards."""
    inverse = F.lit(0xFFFFFFFF) - number
    return (inverse.bitwiseAND(inverse + 1) == 0) | (number.bitwiseAND(number + 1) == 0)


def within(number: Column, network: str) -> Column:
    net = ipaddress.ip_network(network)
    return number.between(int(net.network_address), int(net.broadcast_address))


def ipv4_class(number: Column, quad: Column, resolvers: tuple[str, ...] = book.V4_RESOLVERS) -> Column:
    out = F.when(number.isNull(), F.lit(None).cast("string"))
    for name, networks in book.V4_CLASSES:
        for net in networks:
            out = out.when(within(number, net), name)
    return out.when(quad.isin(*resolvers), "well_known").otherwise("other_unicast")


def pool_slot(index: Column, pools: tuple[str, ...] = book.V4_POOLS) -> Column:
    """The /24 at an index over the pools one after another."""
    nets, out, base = [ipaddress.ip_network(p) for p in pools], None, 0
    for net in nets:
        held = 1 << (24 - net.prefixlen)
        at = F.lit(int(net.network_address)) + (index - base) * 256
        out = F.when(index < base + held, at) if out is None else out.when(index < base + held, at)
        base += held
    return out


def pool_size(pools: tuple[str, ...] = book.V4_POOLS) -> int:
    return sum(1 << (24 - ipaddress.ip_network(p).prefixlen) for p in pools)


def ipv4_seed(number: Column, salt: bytes, pools: tuple[str, ...] = book.V4_POOLS) -> Column:
    """First candidate slot of the address's /24."""
    return modulo(keyed(salt, "v4net", ipv4_text(number - number % 256)), pool_size(pools))


def ipv4_hash(quad: Column, salt: bytes) -> Column:
    return F.concat(F.lit("<IP-"), tag(salt, "ip", quad), F.lit(">"))


def mac_digits(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^0-9A-Fa-f]", ""))


def mac_like(digits: Column, text: Column) -> Column:
    """Twelve digits in the spelling of another MAC."""
    pairs = F.regexp_replace(digits, "(..)(?=.)", "$1:")
    fours = F.regexp_replace(digits, "(....)(?=.)", "$1.")
    return (
        F.when(F.contains(text, F.lit(".")), fours)
        .when(text.rlike("^....-....-....$"), F.translate(fours, ".", "-"))
        .when(F.contains(text, F.lit("-")), F.translate(pairs, ":", "-"))
        .when(F.contains(text, F.lit(":")), pairs).otherwise(digits)
    )


def mac_redacted(text: Column, pool: str = "00005e") -> Column:
    """Vendor half to the pool, device half to zeros; one already in the pool stays."""
    d = mac_digits(text)
    return F.when(F.substring(d, 1, 6) == pool, text).otherwise(mac_like(F.lit(pool + "000000"), text))


def mac_seeded(text: Column, salt: bytes) -> Column:
    """Both halves' first candidates: vendor bits that say multicast or local stay."""
    d = mac_digits(text)
    real = F.conv(F.substring(d, 1, 6), 16, 10).cast("bigint")
    c = low_bits(keyed(salt, "mac-oui", F.substring(d, 1, 6)), 6).bitwiseAND(F.lit(0x3FFFFF))
    head = F.shiftleft(F.shiftright(c, 16), 18).bitwiseOR(real.bitwiseAND(F.lit(0x030000))).bitwiseOR(c.bitwiseAND(F.lit(0xFFFF)))
    hexed = lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")
    return mac_like(F.concat(hexed(head), hexed(low_bits(keyed(salt, "mac", d), 6))), text)


def asn_number(text: Column) -> Column:
    high, low = F.substring_index(text, ".", 1).try_cast("bigint"), F.substring_index(text, ".", -1).try_cast("bigint")
    dotted = F.contains(text, F.lit("."))
    return F.when(dotted & (high <= 65535) & (low <= 65535), high * 65536 + low).when(~dotted & (high <= 0xFFFFFFFF), high)


def asn_space(number: Column) -> Column:
    """The name of the numbers that stand in for each other; null for those that stay."""
    out = F.when(number.isNull(), F.lit(None).cast("string"))
    for a, b in book.ASN_STAY:
        out = out.when(number.between(a, b), F.lit(None).cast("string"))
    for a, b, name in book.ASN_SPACES:
        out = out.when(number.between(a, b), name)
    return out


def asn_seeded(text: Column, salt: bytes) -> Column:
    """First candidate of an AS number in its own space and notation; numbers that stay come back as they are."""

    def shown(n: Column) -> Column:
        new = F.lit(None).cast("bigint")
        for a, b, name in book.ASN_SPACES:
            new = F.when(asn_space(n) == name, F.lit(a) + modulo(keyed(salt, name, n.cast("string")), b - a + 1)).otherwise(new)
        return let(new, lambda v: F.when(F.contains(text, F.lit(".")), F.concat_ws(".", F.shiftright(v, 16), v.bitwiseAND(F.lit(65535)))).otherwise(v.cast("string")))

    return F.when(asn_space(asn_number(text)).isNull(), text).otherwise(let(asn_number(text), shown))
