"""Partition transforms of table formats that Spark's own functions do not compute: ``bucket``.

Murmur3-32 with seed 0: integers and dates as 8 little-endian bytes, strings as UTF-8, decimals as the shortest big-endian
two's complement of the unscaled value. Spark's ``hash`` has another seed and hashes a 4-byte integer as 4 bytes, so it
cannot stand in. The function is an Arrow-batched one, vectorised over values of one length.
"""

from __future__ import annotations

import datetime
import decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash.
_C1, _C2, _ADD, _M1, _M2 = (np.uint32(x) for x in (0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35))


def _rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def murmur3_32(rows: np.ndarray) -> np.ndarray:
    """Signed hashes of byte rows of one length (n x length, uint8)."""
    n, length = rows.shape
    h = np.zeros(n, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, length - 3, 4):
            k = np.ascontiguousarray(rows[:, at : at + 4]).view("<u4").reshape(n) * _C1
            h = _rotate(h ^ (_rotate(k, 15) * _C2), 13) * np.uint32(5) + _ADD
        tail = length % 4
        if tail:
            k = np.zeros(n, np.uint32)
            for i in range(tail):
                k |= rows[:, length - tail + i].astype(np.uint32) << np.uint32(8 * i)
            h ^= _rotate(k * _C1, 15) * _C2
        h ^= np.uint32(length)
        h = (h ^ (h >> np.uint32(16))) * _M1
        h = (h ^ (h >> np.uint32(13))) * _M2
        return (h ^ (h >> np.uint32(16))).view(np.int32)


def _bytes_of(value) -> bytes:
    if isinstance(value, str):
        return value.encode()
    if isinstance(value, decimal.Decimal):
        unscaled = int(value.scaleb(-value.as_tuple().exponent))
        return unscaled.to_bytes((unscaled + (unscaled < 0)).bit_length() // 8 + 1, "big", signed=True)
    if isinstance(value, datetime.date):
        return (value - datetime.date(1970, 1, 1)).days.to_bytes(8, "little", signed=True)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return int(value).to_bytes(8, "little", signed=True)


def hash_values(values: pd.Series) -> pd.Series:
    """The hash of every value; nulls stay null."""
    some = values[values.notna()]
    raw = [_bytes_of(v) for v in some]
    out = np.zeros(len(raw), np.int64)
    lengths = np.array([len(r) for r in raw], np.int64)
    for length in np.unique(lengths):
        pick = np.flatnonzero(lengths == length)
        rows = np.frombuffer(b"".join(raw[i] for i in pick), np.uint8).reshape(len(pick), int(length))
        out[pick] = murmur3_32(rows)
    return pd.Series(out, index=some.index, dtype="Int64").reindex(values.index)


def bucket(n: int, column: Column) -> Column:
    """The bucket number of a value, from 0 to n - 1; null for null."""

    @F.pandas_udf("int")
    def number(values: pd.Series) -> pd.Series:
        return ((hash_values(values) & 0x7FFFFFFF) % n).astype("Int32")

    return number(column)
