"""Texts as flat byte arrays: what the Arrow-batched operators share.

Words are runs of bytes other than space and the five control characters 0x09 to 0x0D. No separator is part of a UTF-8
sequence, so splitting bytes and splitting characters give the same words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and the n + 1 offsets between them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the number of words before it (n + 1 counts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SEPARATOR[data]
    first = np.empty(len(data), dtype=bool)
    first[0] = True
    first[1:] = ~inside[:-1]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    first[cut] = True
    starts = np.flatnonzero(inside & first)
    last = np.empty(len(data), dtype=bool)
    last[-1] = True
    last[:-1] = ~inside[1:]
    last[cut - 1] = True
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def joined_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words (A-Z only) with one space after each: bytes, start and end of each word, words before each text."""
    starts, ends, before = word_bounds(data, offsets)
    lengths = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths + 1, out=at[1:])
    out = np.full(int(at[-1]), 0x20, np.uint8)
    inside = ~SEPARATOR[data]
    keep = np.ones(len(out), dtype=bool)
    keep[at[1:] - 1] = False
    out[keep] = LOWER[data[inside]]
    return out, at[:-1], at[1:] - 1, before


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each slice of ``data``: slices of one length are hashed together, lane by lane."""
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    halves = np.ndarray((len(data) + 1,), dtype="<u4", buffer=padded, strides=(1,))
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    cuts = np.flatnonzero(np.diff(ordered)) + 1
    base = np.uint64(seed)
    with np.errstate(over="ignore"):
        for rows in np.split(order, cuts):
            n = int(lengths[rows[0]])
            if n > 512:
                import xxhash

                out[rows] = [xxhash.xxh64_intdigest(data[s : s + n].tobytes(), seed) for s in starts[rows]]
                continue
            at, p = starts[rows], 0
            if n >= 32:
                acc = [np.full(len(rows), x, np.uint64) for x in (base + _P1 + _P2, base + _P2, base, base - _P1)]
                while p + 32 <= n:
                    acc = [_round(a, lanes[at + (p + 8 * k)]) for k, a in enumerate(acc)]
                    p += 32
                h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
                for a in acc:
                    h = (h ^ _round(np.zeros_like(a), a)) * _P1 + _P4
            else:
                h = np.full(len(rows), base + _P5, np.uint64)
            h = h + np.uint64(n)
            while p + 8 <= n:
                h = _rotl(h ^ _round(np.zeros_like(h), lanes[at + p]), 27) * _P1 + _P4
                p += 8
            if p + 4 <= n:
                h = _rotl(h ^ (halves[at + p].astype(np.uint64) * _P1), 23) * _P2 + _P3
                p += 4
            while p < n:
                h = _rotl(h ^ (padded[at + p].astype(np.uint64) * _P5), 11) * _P1
                p += 1
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            out[rows] = h ^ (h >> np.uint64(32))
    return out
