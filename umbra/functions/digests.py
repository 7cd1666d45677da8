"""Keyed digests as Catalyst expressions; equal to Python's hmac, and to the per-document tier's tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pads(salt: bytes) -> tuple[str, str]:
    """Inner and outer key pads of HMAC-SHA256, in hex."""
    import hashlib

    key = (hashlib.sha256(salt).digest() if len(salt) > 64 else salt).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def keyed(salt: bytes, kind: str, value: Column) -> Column:
    """HMAC-SHA256 of kind, a zero byte and the value, as 64 hex digits."""
    inner, outer = (F.unhex(F.lit(p)) for p in pads(salt))
    message = F.concat(inner, F.encode(F.lit(kind), "UTF-8"), F.unhex(F.lit("00")), F.encode(value, "UTF-8"))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(message, 256))), 256)


def tag(salt: bytes, kind: str, value: Column, digits: int = 6) -> Column:
    """The digest as a number's hex text (no leading zeros), cut to `digits`."""
    return F.substring(F.ltrim(keyed(salt, kind, value), F.lit("0")), 1, digits)


def modulo(digest: Column, n: int) -> Column:
    """The 256-bit digest modulo n, by 16-bit steps; n below 2**47."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substring(digest, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint"))
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, b: (a * 65536 + b) % n)


def low_bits(digest: Column, hex_digits: int) -> Column:
    return F.conv(F.substring(digest, 65 - hex_digits, hex_digits), 16, 10).cast("bigint")
