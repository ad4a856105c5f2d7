"""32-bit hashes in BIGINT arithmetic that stays below 2**63, so ANSI mode never overflows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET, PRIME, MASK = 2166136261, 16777619, 4294967295


#: Powers of PRIME modulo 2**32 as the signed numbers nearest to zero, so that 32 bits times one of them stay below 2**63.
PRIME_2, PRIME_4 = ((pow(PRIME, k, 1 << 32) + (1 << 31)) % (1 << 32) - (1 << 31) for k in (2, 4))


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _times(h: Column, factor: int) -> Column:
    return (h * _long(factor)).bitwiseAND(F.lit(MASK))


def _round(h: Column, byte: Column) -> Column:
    """One byte of FNV-1a."""
    return _times(h.bitwiseXOR(byte), PRIME)


def _push(h: Column, cp: Column) -> Column:
    """The four little-endian bytes of a code point; the last is always zero. Mentions ``h`` once."""
    cp = cp.cast("long")
    h = _round(h, cp.bitwiseAND(_long(255)))
    h = _round(h, F.shiftright(cp, 8).bitwiseAND(_long(255)))
    return _times(h.bitwiseXOR(F.shiftright(cp, 16)), PRIME_2)


def hash_code_points(*cps: Column, after: Column | None = None) -> Column:
    """``after``: the hash of the code points before them."""
    h = _long(OFFSET) if after is None else after
    for cp in cps:
        h = _push(h, cp)
    return h


def hash_array(cps: Column) -> Column:
    """Over an array of code points. A fold keeps the plan small; it is interpreted, so a byte takes one round."""
    return F.aggregate(cps, _long(OFFSET), lambda h, cp: F.when(cp < 256, _times(h.bitwiseXOR(cp), PRIME_4)).otherwise(_push(h, cp)))


def hash_token(token: Column) -> Column:
    """Over the token's code points."""
    return hash_array(F.transform(F.split(token, ""), lambda c: F.ascii(c).cast("long")))


def fnv1a32(text: Column) -> Column:
    """Over the UTF-8 bytes of a string."""
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.substring(F.hex(text), i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    return F.when(text == "", F.lit(OFFSET).cast("long")).otherwise(F.aggregate(octets, F.lit(OFFSET).cast("long"), lambda h, b: _round(h, b)))


def _multiply(h: Column, factor: int) -> Column:
    """h * factor modulo 2**32 in halves."""
    low = h.bitwiseAND(F.lit(65535).cast("long")) * factor
    high = F.shiftleft((F.shiftright(h, 16) * factor).bitwiseAND(F.lit(65535).cast("long")), 16)
    return (low + high).bitwiseAND(F.lit(MASK))


def mix(a: Column, b: Column) -> Column:
    """Of two hashes in order."""
    h = (a * PRIME).bitwiseAND(F.lit(MASK)).bitwiseXOR(F.lit(0x9E3779B9))
    h = (h * PRIME).bitwiseAND(F.lit(MASK)).bitwiseXOR(b)
    h = h.bitwiseXOR(F.shiftright(h, 15))
    h = _multiply(h, 0x85EBCA6B)
    return h.bitwiseXOR(F.shiftright(h, 13))


def crc32(data: Column) -> Column:
    return F.crc32(data)
