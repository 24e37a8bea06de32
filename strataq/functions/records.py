"""Encoded records and a 32-bit hash of keys, for exchange with other stores.

A record is, in big-endian: its whole length (4 bytes), the number of key parts
(2) and each of them behind its length (2), the number of value parts (2) and
each of them behind its length (4).
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from strataq.functions.keys import row_length

# The multiplier and shifts of MurmurHash2.
MULTIPLIER, SHIFT, LAST = 0x5BD1E995, 24, (13, 15)


def _number(x: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(x.cast("long")), 2 * size, "0"))


def encoded(keys: list[Column], values: list[Column]) -> Column:
    """The record of binary or text columns, built by the JVM; null if a part is."""
    parts = [_number(row_length(keys, values), 4)]
    for columns, size in ((keys, 2), (values, 4)):
        parts.append(_number(F.lit(len(columns)), 2))
        for c in columns:
            parts += [_number(F.octet_length(c), size), c.cast("binary")]
    return F.concat(*parts)


def decode(record: bytes) -> tuple[list[bytes], list[bytes]]:
    """Key and value parts of a record; ValueError if it is cut off."""
    (length,) = struct.unpack_from(">i", record)
    if len(record) < length:
        raise ValueError(f"a record of {length} bytes has {len(record)}")
    at, out = 4, []
    for kind in (">h", ">i"):
        (n,) = struct.unpack_from(">h", record, at)
        at, parts = at + 2, []
        for _ in range(n):
            (size,) = struct.unpack_from(kind, record, at)
            at += struct.calcsize(kind)
            parts.append(record[at : at + size])
            at += size
        out.append(parts)
    return out[0], out[1]


@pandas_udf(T.StructType([T.StructField(c, T.ArrayType(T.BinaryType())) for c in ("keys", "values")]))
def decoded(records: pd.Series) -> pd.DataFrame:
    """Key and value parts of records; null for a null one."""
    both = [(None, None) if r is None else decode(bytes(r)) for r in records]
    return pd.DataFrame(both, columns=["keys", "values"])


def murmur32(keys: list[str]) -> np.ndarray:
    """MurmurHash2 with seed 0, as a signed number. The length counts UTF-16 units, of the UTF-8 bytes as many are read, and those left over at the end are signed."""
    data = [k.encode() for k in keys]
    n = np.array([len(k.encode("utf-16-le")) // 2 for k in keys], np.int64)
    width = int(n.max()) // 4 * 4 + 4 if len(keys) else 4
    table = np.frombuffer(b"".join(d[:width].ljust(width, b"\0") for d in data), np.uint8).reshape(len(keys), width)
    words, m, h = table.view("<u4"), np.uint32(MULTIPLIER), n.astype(np.uint32)
    for i in range(width // 4):
        k = words[:, i] * m
        k = (k ^ k >> np.uint32(SHIFT)) * m
        h = np.where(i < n // 4, h * m ^ k, h)
    left = n % 4
    for back in (3, 2, 1):
        byte = table[np.arange(len(keys)), np.maximum(n - back, 0)].view(np.int8).astype(np.int32) << 8 * (back - 1)
        h = np.where(left >= back, h ^ byte.view(np.uint32), h)
    h = np.where(left > 0, h * m, h)
    h = (h ^ h >> np.uint32(LAST[0])) * m
    return (h ^ h >> np.uint32(LAST[1])).astype(np.uint32).view(np.int32)


@pandas_udf(T.IntegerType())
def murmur(keys: pd.Series) -> pd.Series:
    """The hash of each key; null for null."""
    known = keys.notna()
    out = pd.Series(pd.array([None] * len(keys), dtype="Int32"), index=keys.index)
    out[known] = murmur32(list(keys[known]))
    return out
