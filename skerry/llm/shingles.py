"""Near copies by the Jaccard similarity of word shingles: every pair of texts at or above the threshold is found and proved.

SimHash finds the pairs, whole sets prove them, and an exact way follows for pairs that no SimHash radius is sure to hold.

Plan. (1) A narrow pass makes the set of five-word shingle hashes of each text, names it, and keeps its SimHash fingerprint
and its sketch: parities of the shingles over as many places as the set has shingles. Equal sets are one node from then on,
and no set is stored: a later pass makes it again. The same pass counts all shingles of all texts in SLOTS counters.
(2) SimHash, as in ``simhash`` but with a wider radius: the 64 bits are cut into 9 blocks, two fingerprints within 7 bits agree
on at least 2, so each goes under 36 keys and none is missed. Rows of a key are compared 64 at a time on bit planes with
carry-save counters (``simhash.wide_pairs``), and the closest pairs of each row are proved on the whole sets.
(3) The rest. Two sets of similarity 4/5 or more share one of the first n - ceil(4n/5) + 1 shingles of each in any common
order, so a set goes under these keys and no pair is missed. The order puts shingles with high counters last, which keeps
groups small. Neighbours under a key are proved with the pairs of SimHash, then the closest of each row, which joins large
groups by few pairs; at last every pair of different components is looked at. It is the same comparison with another
fingerprint: each shingle that only one of two texts has changes one parity, so sketches never differ in more places than
the texts differ in shingles, and this radius loses no pair. Keys of many rows lie in square tiles, and what the planes leave is
held against prints, sketches of up to 2048 places, before a pair leaves its task.
(4) Pairs go on if their whole sketches allow the similarity, and are proved on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm._chunks import dealt, expand, portions, release, squeeze
from skerry.llm._shared import partitions, written
from skerry.llm._text import flat, joined_words, xxh64
from skerry.llm.simhash import components, majority, wide_pairs

WORDS = 5
#: The least similarity of near copies, as a fraction of integers.
OVER, UNDER = 4, 5
#: Widths of the blocks of a SimHash fingerprint, and the radius within which two fingerprints agree on two whole blocks.
WIDTHS, RADIUS = (8, 7, 7, 7, 7, 7, 7, 7, 7), 7
#: Counters of shingles, and the parts in which they are added up.
SLOTS, PARTS = 1 << 18, 16
#: Rows of one key that are compared in one task; a larger key is laid out in square tiles of this side.
TILE = 8192
#: Words of 64 bits that a print has at most: a sketch as rows of keys carry it.
PRINT_WORDS = 32
#: Bits of the map that keeps texts out of a join.
PLACES = 1 << 22


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and the n + 1 offsets between them. A shorter text is one shingle, one without words none."""
    joined, starts, ends, before = joined_words(data, offsets)
    count = np.diff(before)
    shingles = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    first = np.zeros(len(shingles) + 1, np.int64)
    np.cumsum(shingles, out=first[1:])
    text = np.repeat(np.arange(len(shingles)), shingles)
    w = before[text] + np.arange(first[-1]) - first[text]
    h = xxh64(joined, starts[w], ends[np.minimum(w + words, before[text + 1]) - 1])
    order = np.lexsort((h, text))
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.zeros(len(shingles) + 1, np.int64)
    np.cumsum(np.bincount(text[new], minlength=len(shingles)), out=at[1:])
    return h[new], at


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))


def _sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each range of texts: its bounds, the names of the sets, their hashes and the offsets between them."""
    data, offsets = flat(column)
    for low, high in portions(offsets, 1 << 19):
        h, at = shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        raw = h.astype("<u8").tobytes()
        yield low, high, np.array([xxhash.xxh3_64_intdigest(raw[8 * a : 8 * b]) for a, b in zip(at, at[1:], strict=False)], np.uint64).view(np.int64), h, at
    release()


def _parities(h: np.ndarray, at: np.ndarray, places: np.ndarray) -> list[bytes]:
    """Of each set, the parities of its hashes over its number of places (a power of two, 256 at least), as bits."""
    edges = np.concatenate([[0], np.cumsum(places)])
    owner = np.repeat(np.arange(len(places)), np.diff(at))
    place = edges[owner] + (h & (places[owner] - 1).astype(np.uint64)).astype(np.int64)
    bits = np.packbits((np.bincount(place, minlength=int(edges[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [bits[a // 8 : b // 8] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch over fewer places, a power of two: a place's parity is that of the places that fall on it."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def _named(texts: DataFrame) -> DataFrame:
    """(key, sid, n, fp, sketch) per text: sid names the set, fp is its SimHash fingerprint; and with a part, the counters of a task's shingles in that part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, np.int64)
        names = ["key", "sid", "n", "fp", "sketch", "part"]
        for batch in batches:
            for low, high, sid, h, at in _sets(batch.column(1)):
                seen += np.bincount((h >> np.uint64(32)).astype(np.int64) % SLOTS, minlength=SLOTS)
                n = np.diff(at)
                places = 1 << np.maximum(8, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
                columns = [batch.column(0).slice(low, high - low), pa.array(sid), pa.array(n), pa.array(majority(h, at).view(np.int64)), pa.array(_parities(h, at, places), pa.binary()), pa.nulls(high - low, pa.int32())]
                yield pa.record_batch(columns, names=names)
        own = [squeeze(x) for x in np.split(seen, PARTS)]
        yield pa.record_batch([*[pa.nulls(PARTS, pa.int64())] * 4, pa.array(own, pa.binary()), pa.array(range(PARTS), pa.int32())], names=names)

    return texts.mapInArrow(run, "key long, sid long, n long, fp long, sketch binary, part int")


def _counters(marked: DataFrame) -> np.ndarray:
    """The counters of all texts: SLOTS numbers on the driver, whatever the size of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + expand(blob)[0]
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([squeeze(x) for x in sums.values()], pa.binary())], names=["part", "sketch"])

    rows = dealt(marked.filter("part IS NOT NULL").select("part", "sketch"), PARTS, "part").mapInArrow(run, "part int, sketch binary").collect()
    return np.concatenate([expand(bytes(r.sketch))[0] for r in sorted(rows, key=lambda r: r.part)]) if rows else np.zeros(SLOTS, np.int64)


def _keyed(texts: DataFrame, counters: np.ndarray) -> DataFrame:
    """(k, sid, n) for each shingle of a set's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, sid, h, at in _sets(batch.column(0)):
                n = np.diff(at)
                owner = np.repeat(np.arange(len(sid)), n)
                order = np.lexsort((h, counters[(h >> np.uint64(32)).astype(np.int64) % SLOTS], owner))
                keep = np.zeros(len(sid), bool)
                keep[np.unique(sid, return_index=True)[1]] = True
                prefix = n + (-OVER * n // UNDER) + 1
                chosen = keep[owner] & (np.arange(len(h)) - at[owner] < prefix[owner])
                yield pa.record_batch([pa.array(h[order][chosen].view(np.int64)), pa.array(sid[owner[chosen]]), pa.array(n[owner[chosen]])], names=["k", "sid", "n"])

    return texts.select("text").mapInArrow(run, "k long, sid long, n long")


def _whole_keys(batches: Iterator[pa.RecordBatch], least: int = 200_000) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by their first column, in portions that do not cut a key."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size < least or held[0][0][0] == held[-1][0][-1]:
            continue
        whole = [np.concatenate(x) for x in zip(*held, strict=True)]
        cut = size - int(np.argmax(whole[0][::-1] != whole[0][-1]))
        yield [c[:cut] for c in whole]
        held, size = [[c[cut:] for c in whole]], size - cut
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return UNDER * np.minimum(a, b) >= OVER * np.maximum(a, b)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (k, sid): the rows under keys of several sets (kind 0: k, sid, n), and pairs of neighbours (kind 1)."""
    for k, sid, n in _whole_keys(batches):
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (sid[1:] != sid[:-1])
        k, sid, n = k[new], sid[new], n[new]
        same = np.concatenate([[False], k[1:] == k[:-1], [False]])
        many = same[1:] | same[:-1]
        k, sid, n = k[many], sid[many], n[many]
        near = (k[1:] == k[:-1]) & _fits(n[1:], n[:-1])
        pairs = np.unique(np.column_stack([sid[1:][near], sid[:-1][near]]), axis=0)
        kind = np.repeat(np.array([0, 1], np.int32), [len(k), len(pairs)])
        yield pa.record_batch([pa.array(kind), pa.array(np.concatenate([k, pairs[:, 0]])), pa.array(np.concatenate([sid, pairs[:, 1]])), pa.array(np.concatenate([n, np.zeros(len(pairs), np.int64)]))], names=["kind", "a", "b", "n"])


def _tiled(rows: DataFrame, tile: int, last: str = "root", spread: bool = False) -> DataFrame:
    """Rows (k, sid, n, ``last``) with k the key or a tile of it, and side: within a tile off the diagonal, rows of side 0 meet
    those of side 1 only. With ``spread`` the rows do not lie by key yet and stay where they are: only keys of more than
    ``tile`` rows, of which there is one in so many rows at most, are sent to them."""
    sizes = rows.groupBy("k").agg(F.count("*").alias("m"))
    sized = rows.join(F.broadcast(sizes.filter(F.col("m") > tile)), "k", "left").fillna(0, "m") if spread else rows.join(sizes, "k")
    across = F.ceil(F.col("m") / tile).cast("int")
    own = F.pmod(F.xxhash64("sid", F.lit(7)), across).cast("int")
    kept = ["sid", "n", last]
    small = sized.filter(F.col("m") <= tile).select("k", F.lit(2).alias("side"), *kept)
    large = sized.filter(F.col("m") > tile).select("k", *kept, own.alias("s"), F.explode(F.sequence(F.lit(0), across - 1)).alias("o"))
    side = F.when(F.col("s") == F.col("o"), 2).when(F.col("s") < F.col("o"), 0).otherwise(1)
    return small.unionByName(large.select(F.xxhash64("k", F.least("s", "o"), F.greatest("s", "o")).alias("k"), side.alias("side"), *kept))


def _refined(i: np.ndarray, j: np.ndarray, n: np.ndarray, prints: list[np.ndarray]) -> np.ndarray:
    """The share of places, of the sets' shingles, in which the prints of each pair differ, over as many places as the smaller has."""
    share = np.zeros(len(i))
    width = np.array([len(x) for x in prints])
    both = np.minimum(width[i], width[j])
    for words in np.unique(both):
        at = np.flatnonzero(both == words)
        used, place = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        bits = np.stack([folded(prints[r], int(words)) for r in used])
        differ = np.bitwise_count(bits[place[: len(at)]] ^ bits[place[len(at) :]]).sum(axis=1, dtype=np.int64)
        share[at] = differ / np.maximum(n[i[at]] + n[j[at]], 1)
    return share


def _closest(i: np.ndarray, j: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Which of the pairs are the closest of one of their rows."""
    row, pair = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)
    order = np.lexsort((pair, share[pair], row))
    first = np.concatenate([[True], row[order][1:] != row[order][:-1]])[: len(order)]
    return np.unique(pair[order][first])


def _until(k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of rows sorted by k and n, where the rows that each can be similar to end: under its key, up to 5/4 as large."""
    edges = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
    until = np.empty(len(k), np.int64)
    for low, high in zip(edges, edges[1:], strict=False):
        until[low:high] = low + np.searchsorted(n[low:high], UNDER * n[low:high] // OVER, side="right")
    return until


def _blocked(nodes: DataFrame) -> DataFrame:
    """(k, sid, n, fp) for each choice of as many blocks as fingerprints within the radius agree on."""
    edges = np.concatenate([[0], np.cumsum(WIDTHS)]).tolist()
    blocks = [F.shiftrightunsigned("fp", e).bitwiseAND(F.lit((1 << w) - 1)) for e, w in zip(edges, WIDTHS, strict=False)]
    keys = [F.lit(t << 16) + F.shiftleft(blocks[i], 8) + blocks[j] for t, (i, j) in enumerate(combinations(range(len(WIDTHS)), len(WIDTHS) - RADIUS))]
    return nodes.select(F.explode(F.array(*keys)).alias("k"), "sid", "n", "fp")


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (k, n, side, sid, fp) sorted by k and n: of each row its closest under a key, if SimHash fingerprints are within the
    radius and sizes allow it."""
    for k, n, side, sid, fp in _whole_keys(batches, 50_000):
        bits = fp.view(np.uint64)[:, None]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i, j in wide_pairs(bits, _until(k, n), np.full(len(k), RADIUS)):
            differ = np.bitwise_count(bits[i, 0] ^ bits[j, 0])
            good = (differ <= RADIUS) & ((side[i] == 2) | (side[i] != side[j])) & _fits(n[i], n[j])
            i, j, differ = i[good], j[good], differ[good]
            keep = _closest(i, j, differ)
            found.append((i[keep], j[keep], differ[keep]))
        i, j, differ = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = _closest(i, j, differ)
        i, j = i[keep], j[keep]
        pairs = np.unique(np.column_stack([np.maximum(sid[i], sid[j]), np.minimum(sid[i], sid[j])]), axis=0)
        if len(pairs):
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _simhash_pairs(nodes: DataFrame, tile: int) -> DataFrame:
    """Pairs (a, b) of the sets' names that SimHash finds: for each set its closest within the radius."""
    n = partitions(nodes.sparkSession)
    rows = _tiled(_blocked(nodes), tile, "fp", spread=True).repartition(n, "k").sortWithinPartitions("k", "n")
    return rows.select("k", "n", "side", "sid", "fp").mapInArrow(_alike, "a long, b long").distinct()


def _across(closest: bool):
    """Of rows (k, n, side, sid, root, print) sorted by k and n: pairs of different roots that sizes and prints allow; with
    ``closest``, of each row only its closest under a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, n, side, sid, root, raw in _whole_keys(batches, 50_000):
            prints = [np.frombuffer(x, "<u8") for x in raw]
            bits = np.stack([folded(x, 4) for x in prints])
            until = _until(k, n)
            limit = (UNDER - OVER) * 2 * n // (UNDER + OVER)
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for i, j in wide_pairs(bits, until, limit):
                good = (root[i] != root[j]) & ((side[i] == 2) | (side[i] != side[j])) & _fits(n[i], n[j])
                i, j = i[good], j[good]
                share = _refined(i, j, n, prints)
                near = share * (UNDER + OVER) <= (UNDER - OVER) * (1 + 1e-9)
                i, j, share = i[near], j[near], share[near]
                if closest:
                    keep = _closest(i, j, share)
                    i, j, share = i[keep], j[keep], share[keep]
                found.append((i, j, share))
            i, j, share = (np.concatenate(x) for x in zip(*found, strict=True))
            if closest:
                keep = _closest(i, j, share)
                i, j = i[keep], j[keep]
            pairs = np.unique(np.column_stack([np.maximum(sid[i], sid[j]), np.minimum(sid[i], sid[j])]), axis=0)
            if len(pairs):
                yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _prints(rows: DataFrame, words: int = PRINT_WORDS) -> DataFrame:
    """``rows`` with the sketch folded to at most so many words, as ``print``."""
    rest = [f for f in rows.schema.fields if f.name != "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [x if len(x) <= 8 * words else folded(np.frombuffer(x, "<u8"), words).tobytes() for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.record_batch([*batch.columns[:-1], pa.array(own, pa.binary())], names=[*batch.schema.names[:-1], "print"])

    return rows.select(*[f.name for f in rest], "sketch").mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rest), "print binary"]))


def _needed_sets(need: DataFrame, texts: DataFrame) -> DataFrame:
    """(sid, prints) of the sets in ``need`` (sid, least). A bitmap of their keys, 65536 words at most, keeps most other texts out of the join."""
    place = F.pmod(F.xxhash64("least"), F.lit(PLACES))
    words = need.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(least), {PLACES}) % 64 AS INT))").alias("bit"))
    bitmap = np.zeros(PLACES // 64, np.int64)
    for r in words.groupBy("w").agg(F.bit_or("bit").alias("bit")).collect():
        bitmap[r.w] = r.bit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bitmap[at >> 6].view(np.uint64) >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            if not batch.num_rows:
                continue
            for low, high, sid, h, at in _sets(batch.column(1)):
                prints = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer((8 * at).astype("<i4").tobytes()), pa.py_buffer(h.astype("<u8").tobytes())])
                yield pa.record_batch([batch.column(0).slice(low, high - low), pa.array(sid), prints], names=["key", "s", "prints"])

    own = texts.select("key", "text", F.pmod(F.xxhash64("key"), F.lit(PLACES)).alias("at")).mapInArrow(run, "key long, s long, prints binary")
    return own.join(need, (own.s == need.sid) & own.key.eqNullSafe(need.least)).groupBy("sid").agg(F.first("prints").alias("prints"))


def _joined(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) with columns of both sides, named after a and b."""
    one, two = (table.select(F.col("sid").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in columns]) for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", *[f"{x}_{c}" for x in columns for c in "ab"])


def _allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, n_a, n_b, sketch_a, sketch_b): the pairs that sizes and sketches allow."""
    for batch in batches:
        n, m = (batch.column(i).to_numpy() for i in (2, 3))
        near = _fits(n, m)
        for i in np.flatnonzero(near):
            x, y = (np.frombuffer(batch.column(c)[int(i)].as_buffer(), "<u8") for c in (4, 5))
            words = min(len(x), len(y))
            near[i] = np.bitwise_count(folded(x, words) ^ folded(y, words)).sum(dtype=np.int64) * (UNDER + OVER) <= (UNDER - OVER) * (n[i] + m[i])
        yield batch.select(["a", "b"]).filter(pa.array(near))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, prints_a, prints_b): the pairs whose whole sets have the similarity."""
    for batch in batches:
        near = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            near.append(UNDER * both >= OVER * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def _proved(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets have the similarity; sizes and sketches turn most others away before."""
    pairs = written(_joined(pairs.distinct(), nodes, "n", "sketch").mapInArrow(_allowed, "a long, b long"), "pairs")
    need = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct().join(nodes.select("sid", "least"), "sid")
    sets = written(_needed_sets(written(need, "need"), texts), "sets")
    return written(_joined(pairs, sets, "prints").mapInArrow(_similar, "a long, b long"), "proved")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """(key, component): per row, the smallest key that chains of texts of similarity 4/5 or more reach.

    A null text is an empty one. Texts without words are copies of each other; a text of fewer than five words is one shingle.
    Rows with equal keys stay separate rows; a null key never is a component's name unless the component has no other. Other
    columns are ignored. An empty table gives an empty result.
    """
    texts = _texts(docs, key, text)
    marked = written(_named(texts), "shingles")
    named = marked.filter("part IS NULL")
    nodes = written(named.groupBy("sid").agg(F.min("key").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch")), "nodes")
    n = partitions(docs.sparkSession)
    keyed = _keyed(texts, _counters(marked)).repartition(n, "k").sortWithinPartitions("k", "sid")
    met = written(keyed.mapInArrow(_groups, "kind int, a long, b long, n long"), "met")
    found = components(_proved(_simhash_pairs(nodes, tile).unionByName(met.filter("kind = 1").select("a", "b")), nodes, texts))
    rows = met.filter("kind = 0").select(F.col("a").alias("k"), F.col("b").alias("sid"), "n")
    prints = _prints(nodes.select("sid", "sketch"))
    for closest in (True, False):
        # keys whose sets are of several components by now; the last time every pair of them is looked at
        open_rows = rows.join(found.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        open_keys = open_rows.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("k")
        rest = _tiled(open_rows.join(open_keys, "k"), tile).join(prints, "sid").repartition(n, "k").sortWithinPartitions("k", "n")
        across = rest.select("k", "n", "side", "sid", "root", "print").mapInArrow(_across(closest), "a long, b long")
        found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_proved(across, nodes, texts)))
    rooted = nodes.join(found, nodes.sid == found.node, "left").select("sid", "least", F.coalesce("root", "sid").alias("root"))
    by_set = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("sid", "component")
    return named.select("key", "sid").join(by_set, "sid").select(F.col("key").alias(key), "component")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of its component, as in ``simhash.keep_one``."""
    found = near_duplicates(docs, key, text).filter(F.col(key).eqNullSafe(F.col("component"))).select(F.col(key).alias("__kept")).distinct()
    return docs.join(found, F.col(f"`{key}`").eqNullSafe(F.col("__kept")), "left_semi")
