"""SimHash near-duplicates: fingerprints, exact search within a radius by bit-sliced comparison, and components.

Plan. (1) One narrow pass makes fingerprints. (2) Equal fingerprints meet in one partial aggregate, so a group of copies,
however large, is one row from then on. (3) The 64 bits are cut into 6 blocks; two fingerprints within 3 bits agree on
at least 3 whole blocks, so each fingerprint goes under 20 keys (3 of 6 blocks) and none is missed. (4) Rows of one key
are compared 64 at a time: bit planes stand vertically in 64-bit words, a carry-save counter of two bits and an overflow
word adds up 64 distances at once, and a block whose distances have all passed the radius is abandoned. Only links to a
local root leave a task, never the pairs. (5) Alternating star contraction joins the links into components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm._shared import forget, partitions, written
from skerry.llm._text import flat, joined_words, xxh64

WIDTHS = (11, 11, 11, 11, 10, 10)
RADIUS = 3
#: Rows of one key that are compared in one task; a larger key is laid out in square tiles of this side.
TILE = 16_384
_AT_ONCE = 1 << 18


def fingerprints(texts: pa.Array, words: int = 3, seed: int = 42) -> np.ndarray:
    """The 64-bit fingerprint of each text: a bit is set if over half of its shingles' XXH64 hashes have it."""
    data, offsets = flat(texts)
    joined, starts, ends, before = joined_words(data, offsets)
    count = np.diff(before)
    shingles = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    first = np.zeros(len(shingles) + 1, np.int64)
    np.cumsum(shingles, out=first[1:])
    text = np.repeat(np.arange(len(shingles)), shingles)
    votes = np.zeros((len(shingles), 64), np.int64)
    for low in range(0, int(first[-1]), _AT_ONCE):
        t = text[low : low + _AT_ONCE]
        w = before[t] + (np.arange(low, low + len(t)) - first[t])
        h = xxh64(joined, starts[w], ends[np.minimum(w + words, before[t + 1]) - 1], seed)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        votes[t[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    return np.packbits(votes * 2 > shingles[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def majority(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 64-bit fingerprint of each set of hashes (``at``: the n + 1 offsets between them), as ``fingerprints`` has it."""
    size = np.diff(at)
    votes, owner = np.zeros((len(size), 64), np.int64), np.repeat(np.arange(len(size)), size)
    for low in range(0, len(h), _AT_ONCE):
        t = owner[low : low + _AT_ONCE]
        bits = np.unpackbits(h[low : low + _AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        votes[t[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    return np.packbits(votes * 2 > size[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def with_fingerprint(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fp long) per row; a null text is an empty one and gets fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(fingerprints(batch.column(1)).view(np.int64))], names=["key", "fp"])

    return docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "key long, fp long")


def masks() -> list[int]:
    """For each choice of 3 of the 6 blocks, the 64-bit mask of their bits."""
    edges = np.concatenate([[0], np.cumsum(WIDTHS)])
    blocks = [((1 << w) - 1) << int(e) for w, e in zip(WIDTHS, edges, strict=False)]
    return [sum(c) for c in combinations(blocks, len(WIDTHS) - RADIUS)]


def _planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of each 64 fingerprints in turn: row b, plane p is the word of bit p of the 64 members of block b."""
    blocks = -(-len(fps) // 64)
    padded = np.zeros(blocks * 64, "<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(blocks, 64, 8), axis=2, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.transpose(0, 2, 1)), axis=2, bitorder="little").reshape(-1).view("<u8").reshape(blocks, 64)


def near_pairs(fps: np.ndarray, until: np.ndarray, radius: int = RADIUS, after: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), ``after[i] < j < until[i]`` (i itself by default), within the radius (3 at most), in bounded portions."""
    n = len(fps)
    if radius > 3:
        raise ValueError("the carry-save counter holds distances up to 3")
    low = np.arange(1, n + 1) if after is None else after + 1
    planes = _planes(fps)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    first_block, stop_block = low // 64, -(-until // 64)
    spans = np.maximum(stop_block - first_block, 0) * (low < until)
    begin = np.zeros(n + 1, np.int64)
    np.cumsum(spans, out=begin[1:])
    at, step = 0, 1 << 15
    while at < begin[-1]:
        top = min(at + step, int(begin[-1]))
        pair = np.arange(at, top)
        q = np.searchsorted(begin, pair, side="right") - 1
        b = first_block[q] + (pair - begin[q])
        at = top
        lo = np.clip(low[q] - b * 64, 0, 63).astype(np.uint64)
        hi = np.clip(until[q] - b * 64, 0, 64)
        valid = (ones << lo) & np.where(hi == 64, ones, (np.uint64(1) << np.minimum(hi, 63).astype(np.uint64)) - np.uint64(1))
        c0 = np.zeros(len(q), np.uint64)
        c1 = np.zeros(len(q), np.uint64)
        over = ~valid
        for group in range(0, 64, 8):
            want = fps[q]
            for p in range(group, group + 8):
                x = planes[b, p] ^ (np.uint64(0) - ((want >> np.uint64(p)) & np.uint64(1)))
                carry = c0 & x
                c0 ^= x
                over |= c1 & carry
                c1 ^= carry
            live = over != ones
            if not live.all():  # a block in which every distance has passed the radius is abandoned
                q, b, c0, c1, over = q[live], b[live], c0[live], c1[live], over[live]
                if not len(q):
                    break
        if len(q):
            if radius < 3:
                over |= c1 & c0 if radius == 2 else (c1 if radius == 1 else c1 | c0)
            hit = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, bit = np.nonzero(hit)
            yield q[k], b[k] * 64 + bit


def wide_planes(bits: np.ndarray) -> np.ndarray:
    """``_planes`` for fingerprints of several 64-bit words: row b, plane p is the word of bit p of the 64 members of block b."""
    return np.concatenate([_planes(np.ascontiguousarray(bits[:, w])) for w in range(bits.shape[1])], axis=1)


def _add(counters: list[np.ndarray], planes: list[np.ndarray]) -> None:
    """Add eight one-bit planes to vertical counters: a tree of carry-save adders, whose carries go on from counter to counter."""

    def save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = a ^ b
        return half ^ c, (a & b) | (half & c)

    ones, carries = counters[0], planes
    for level in range(3):
        out = []
        for i in range(0, len(carries), 2):
            ones, up = save(ones, carries[i], carries[i + 1])
            out.append(up)
        counters[level], carries = ones, out
        ones = counters[level + 1]
    carry = carries[0]
    for level in range(3, len(counters)):
        counters[level], carry = counters[level] ^ carry, counters[level] & carry


def _beyond(counters: list[np.ndarray], limit: np.ndarray) -> np.ndarray:
    """Per lane, whether its counter is greater than ``limit``."""
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    more, equal = np.zeros(len(limit), np.uint64), np.full(len(limit), ones)
    for level in range(len(counters) - 1, -1, -1):
        wanted = np.uint64(0) - ((limit >> level) & 1).astype(np.uint64)
        more |= equal & counters[level] & ~wanted
        equal &= ~(counters[level] ^ wanted)
    return more


def wide_pairs(bits: np.ndarray, until: np.ndarray, limit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j < until[i], whose fingerprints (rows of ``bits``) differ in at most ``limit[j]`` bits, and a few
    that differ in more; ``limit`` grows with the index within ``until``. In bounded portions.

    As in ``near_pairs`` 64 distances are added up at once, eight planes at a time, and a block is abandoned when all of them
    have passed its largest limit.
    """
    n, width = len(bits), bits.shape[1] * 64
    planes, low = wide_planes(bits), np.arange(1, n + 1)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    first = low // 64
    spans = np.maximum(-(-until // 64) - first, 0) * (low < until)
    begin = np.concatenate([[0], np.cumsum(spans)])
    levels = max(width.bit_length(), 4)
    for at in range(0, int(begin[-1]), 1 << 14):
        pair = np.arange(at, min(at + (1 << 14), int(begin[-1])))
        q = np.searchsorted(begin, pair, side="right") - 1
        b = first[q] + (pair - begin[q])
        lo, hi = np.clip(low[q] - b * 64, 0, 63).astype(np.uint64), np.clip(until[q] - b * 64, 0, 64)
        outside = ~((ones << lo) & np.where(hi == 64, ones, (np.uint64(1) << np.minimum(hi, 63).astype(np.uint64)) - np.uint64(1)))
        most = np.minimum(limit[np.minimum(until[q], (b + 1) * 64) - 1], width)
        counters = [np.zeros(len(q), np.uint64) for _ in range(levels)]
        for group in range(0, width, 8):
            word = bits[q, group // 64]
            _add(counters, [planes[b, p] ^ (np.uint64(0) - ((word >> np.uint64(p % 64)) & np.uint64(1))) for p in range(group, group + 8)])
            if group % 32 == 24:
                live = (_beyond(counters, most) | outside) != ones
                if not live.all():
                    q, b, outside, most = q[live], b[live], outside[live], most[live]
                    counters = [c[live] for c in counters]
                if not len(q):
                    break
        if len(q):
            near = ~(_beyond(counters, most) | outside)
            k, bit = np.nonzero(np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield q[k], b[k] * 64 + bit


def _union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join i and j: labels are indices of smaller members and end as roots."""
    while len(i):
        a, b = label[i], label[j]
        while True:
            a2, b2 = label[a], label[b]
            if np.array_equal(a, a2) and np.array_equal(b, b2):
                break
            a, b = a2, b2
        differ = a != b
        if not differ.any():
            break
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


def _roots(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def _links(keys: np.ndarray, side: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, root's fp) among rows sorted by (key, side). Within a key, side 0 and side 1 rows are compared with each
    other only, side 2 rows with all that follow: side 2 is a whole key or a tile on the diagonal."""
    n = len(keys)
    change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    edges = np.concatenate([[0], change, [n]])
    until = np.repeat(edges[1:], np.diff(edges))
    after = np.arange(n)
    if (side != 2).any():
        ones_from = np.flatnonzero(side == 1)
        group = np.searchsorted(edges, np.arange(n), side="right") - 1
        start = np.full(len(edges) - 1, n, np.int64)
        np.minimum.at(start, group[ones_from], ones_from)
        after = np.where(side == 0, start[group] - 1, after)
        until = np.where(side == 1, 0, until)
    label = np.arange(n)
    for i, j in near_pairs(fps, until, radius, after):
        _union(label, i, j)
    label = _roots(label)
    moved = label != np.arange(n)
    return fps[moved], fps[label[moved]]


def near_links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b), b an equal or other fingerprint within reach, that join exactly the fingerprints (column fp, distinct)
    which chains of steps of at most ``radius`` differing bits join."""
    n = partitions(fps.sparkSession)
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("v")) for i, m in enumerate(masks())]))
    keyed = fps.select("fp", table.alias("k")).select(F.xxhash64("k.t", "k.v").alias("k"), "fp")
    sized = keyed.groupBy("k").agg(F.count("*").alias("m")).filter(F.col("m") > 1)
    joined = keyed.join(sized, "k")  # alone under its key, a fingerprint has nothing to be compared with
    side = F.ceil(F.col("m") / tile).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), side).cast("int")
    other = F.explode(F.sequence(F.lit(0), side - 1)).alias("o")
    small = joined.filter(F.col("m") <= tile).select("k", F.lit(2).alias("side"), "fp")
    large = joined.filter(F.col("m") > tile).select("k", "fp", own.alias("s"), other)
    large = large.select(
        F.xxhash64("k", F.least("s", "o"), F.greatest("s", "o")).alias("k"),
        F.when(F.col("s") == F.col("o"), 2).when(F.col("s") < F.col("o"), 0).otherwise(1).alias("side"),
        "fp",
    )
    rows = small.unionByName(large).repartition(n, "k").sortWithinPartitions("k", "side", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out(parts):
            a, b = _links(parts[0], parts[1], parts[2].view(np.uint64), radius)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            size += batch.num_rows
            if size < 200_000 or held[0][0][0] == held[-1][0][-1]:
                continue
            k, s, f = (np.concatenate([h[i] for h in held]) for i in range(3))
            cut = len(k) - int(np.argmax(k[::-1] != k[-1])) if k[0] != k[-1] else 0
            yield out((k[:cut], s[:cut], f[:cut]))
            held, size = [[k[cut:], s[cut:], f[cut:]]], len(k) - cut
        if held:
            yield out([np.concatenate([h[i] for h in held]) for i in range(3)])

    return rows.select("k", "side", "fp").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches, by alternating large-star and small-star steps.

    A node's neighbours are never gathered: its smallest neighbour comes from a partial aggregate and goes back over a
    join, which adaptive execution splits where a node has very many links. Unlinked nodes are not in the result. Rounds go on
    until nothing changes; their number grows with the logarithm of the longest path.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        back = both.join(least, "u")
        if large:
            new = back.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            new = back.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return new.filter(F.col("a") != F.col("b")).distinct()

    def print_of(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = written(links.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "links")
    seen, now = None, print_of(edges)
    while now != seen:
        before, edges, seen = edges, written(star(star(edges, True), False), "links"), now
        forget(before)
        now = print_of(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(key, fp long, component): per row, its fingerprint and the smallest key that chains of near fingerprints reach.

    Rows without words share fingerprint zero and are linked like any others. Rows with equal keys stay separate rows; a
    null key never is a component's name unless the component has no other. An empty table gives an empty result.
    """
    marked = written(with_fingerprint(docs, key, text), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("key").alias("least")), "nodes")
    found = components(near_links(nodes.select("fp"), radius))
    named = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    by_print = named.join(smallest, "root").select("fp", "component")
    return marked.join(by_print, "fp").select(F.col("key").alias(key), "fp", "component")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of its component: one document of each group of near copies.

    Rows that repeat a kept key all stay; so do rows without a key where nothing with a key is near.
    """
    found = near_duplicates(docs, key, text, radius).filter(F.col(key).eqNullSafe(F.col("component"))).select(F.col(key).alias("__kept")).distinct()
    return docs.join(found, F.col(f"`{key}`").eqNullSafe(F.col("__kept")), "left_semi")
