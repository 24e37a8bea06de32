"""Hashes of keys, sizes of Bloom filters and of encoded records, as JVM-side columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_31(key: Column) -> Column:
    """The first four bytes of the MD5 digest, big-endian, without the sign bit."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(2147483647).cast("long"))


def bit_position(key: Column, bits: Column | int) -> Column:
    """The key's bit in a filter of ``bits``."""
    return F.pmod(md5_31(key), bits if isinstance(bits, Column) else F.lit(bits).cast("long"))


def bloom_bits(records: Column, rate: float) -> Column:
    """Bits of a filter for ``records`` keys at a false-positive rate: a multiple of 64, at least 64."""
    raw = F.floor(records.cast("double") * F.lit(-math.log(rate) / math.log(2) ** 2))
    return F.greatest(F.ceil(raw / F.lit(64.0)) * 64, F.lit(64)).cast("long")


def bloom_fpp(records: Column, bits: Column, hashes: int = 2) -> Column:
    """Expected false-positive rate of a filter that holds ``records`` keys."""
    return F.pow(F.lit(1.0) - F.exp(F.lit(-float(hashes)) * records.cast("double") / bits.cast("double")), F.lit(float(hashes)))


def row_length(keys: list[Column], values: list[Column]) -> Column:
    """Bytes of an encoded record: a total, two counts, and each part behind its length."""
    total = F.lit(4 + 2 + 2).cast("long")
    for k in keys:
        total = total + F.lit(2) + F.octet_length(k)
    for v in values:
        total = total + F.lit(4) + F.octet_length(v)
    return total
