"""Suffix-array dedup: bytes of passages that an earlier document has, found by deep-shallow sorting.

A byte goes if some 50-byte string over it also starts in a document with a smaller key. Sorting all suffixes of a corpus
in one place is not possible; all suffixes that could be equal over 50 bytes are brought together instead:

1. Each 50-byte window is named by the smallest 20-byte gram in it (its anchor), which any copy of the window shares.
   Chunks send buckets their distinct anchors; buckets answer which occur in more than one document. The rest cannot match.
2. For anchors that remain, chunks send the stretch of text whose windows they name, each distinct stretch once, with
   the smallest key that has it. So a passage in a third of all documents is one stretch per chunk.
3. A bucket sorts the suffixes that start in its stretches: multikey quicksort on 8-byte characters to a depth of 16
   bytes, then blind tries for groups with longer common prefixes. Runs with a common prefix of 50 bytes get their smallest
   key, and every stretch learns which of its windows are earlier elsewhere.
4. Chunks mark the covered bytes of their documents.

Strings are judged on the input, all positions of all texts take part, and the work follows the number of bytes. Hashes only
choose what is compared: bytes go because they are equal to earlier bytes, never because hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from skerry.llm._chunks import ROWS, TEXTS, dealt, expand, grouped, others_of, portions, release, runs, squeeze, text_blobs, texts_of, to_buckets, with_chunks
from skerry.llm._shared import partitions, written
from skerry.llm._text import flat

WINDOW = 50
GRAM = 20
#: Bytes that multikey quicksort orders before blind tries take over.
SHALLOW = 16
_SPAN = WINDOW - GRAM + 1
_POWER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_POWER, -1, 1 << 64)
_BYTES = np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PIECE = 1 << 20
#: Anchors are told apart by 48 bits: a false match only sends a stretch for nothing.
_KEY_BITS = np.uint64(0xFFFFFFFFFFFF0000)
_LAST_KEY = np.iinfo(np.int64).max
_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _POWER), ("down", _INVERSE)):
            table = np.full(max(n, _PIECE + 4096), np.uint64(base))
            table[0] = 1
            np.multiply.accumulate(table, out=table)
            _powers[name] = table
    return _powers["up"][:n], _powers["down"][:n]


class Stretches:
    """For some documents: each anchor's run of windows. ``low`` to ``high`` are window starts in the given bytes, ``anchor`` the
    anchor's key and ``text`` a hash of the bytes from ``low`` to the end of the last window, ``doc`` the document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        with np.errstate(over="ignore"):
            up, down = _tables(n + 1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTES[data] * up[:n], out=sums[1:])
            if n < WINDOW:
                h = np.zeros(0, np.uint64)
            else:
                h = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1] * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
            key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
            span = 1
            while span * 2 <= _SPAN:
                key = np.minimum(key[:-span], key[span:])
                span *= 2
            if span < _SPAN and len(key):
                key = np.minimum(key[: len(key) - (_SPAN - span)], key[_SPAN - span :])
            at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            first = np.empty(len(at), bool)
            first[:1] = True
            first[1:] = at[1:] != at[:-1]
            inside = np.ones(len(at), bool)
            ends = offsets[1:]
            reach = (ends[:, None] - np.arange(1, WINDOW)[None, :]).reshape(-1)  # windows that would cross a document's end
            begins = np.repeat(offsets[:-1], WINDOW - 1)
            reach = reach[(reach >= begins) & (reach < len(at))]
            inside[reach] = False
            starts = offsets[:-1]
            first[starts[starts < len(at)]] = True
            first &= inside
            self.low = np.flatnonzero(first)
            stop = np.ones(len(at) + 1, bool)
            stop[:-1] = first | ~inside
            stops = np.flatnonzero(stop)
            self.high = stops[np.searchsorted(stops, self.low, side="right")]  # one past the last window
            self.end = self.high - 1 + WINDOW
            # smallest grams have small hashes: mixed again, keys spread evenly over the ranges that buckets have
            least = h[at[self.low]] * np.uint64(0x9FB21C651E98DF25)
            least = (least ^ (least >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            self.anchor = (least ^ (least >> np.uint64(32))) & _KEY_BITS
            self.doc = np.searchsorted(offsets, self.low, side="right") - 1
            mixed = (sums[self.end] - sums[self.low]) * down[self.low] + (self.end - self.low).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
            self.text = mixed ^ (mixed >> np.uint64(29))


def _stretches_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, Stretches]]:
    for a, b in portions(offsets, _PIECE):
        base = offsets[a]
        yield a, int(base), Stretches(data[base : offsets[b]], offsets[a : b + 1] - base)


def _multikey_quicksort(words: np.ndarray, starts: np.ndarray, places: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the suffixes by their characters at ``places``, and where groups that are equal there begin and how many they are.

    All groups of one depth are partitioned at once, each by its own next character; only those that are equal in it go one
    character deeper, so a suffix is read no further than it takes to tell it from the others.
    """
    order, low, size = np.arange(len(starts)), np.zeros(min(1, len(starts)), np.int64), np.full(min(1, len(starts)), len(starts))
    for place in places:
        many = size > 1
        low, size = low[many], size[many]
        if not len(low):
            break
        group = np.repeat(np.arange(len(low)), size)
        slot = np.arange(len(group)) + np.repeat(low - (np.cumsum(size) - size), size)
        character = words[starts[order[slot]] + place].astype(np.uint64)
        by = np.argsort(character) if len(low) == 1 else np.lexsort((character, group))
        order[slot] = order[slot][by]
        character = character[by]
        heads = np.flatnonzero(np.concatenate([[True], (character[1:] != character[:-1]) | (group[1:] != group[:-1])]))
        low, size = slot[heads], np.diff(np.append(heads, len(slot)))
    return order, low, size


def _blind_tries(words: np.ndarray, starts: np.ndarray, places: list[int], order: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Put the members of each group (``size`` of them from ``order[low]`` on) in order, and return the places in the order whose
    suffix equals the one before.

    A group's trie is built along the path of its first member: every other member leaves that path at its first character
    that differs, and only that character is kept, as a blind trie does. Read in order, a path has first the branches with
    smaller characters from the top down, then the members equal to it, then those with greater characters from the bottom
    up. Members that leave at one place by one character are a trie of their own and go on below it.
    """
    equal, depth = [np.zeros(0, np.int64)], np.zeros(len(low), np.int64)
    end = len(places)
    while (many := size > 1).any():
        low, size, depth = low[many], size[many], depth[many]
        group = np.repeat(np.arange(len(low)), size)
        first = np.cumsum(size) - size
        slot = np.arange(len(group)) + np.repeat(low - first, size)
        start = starts[order[slot]]
        leaves, branch, greater = np.full(len(group), end), np.zeros(len(group), np.uint64), np.zeros(len(group), bool)
        for j in range(end - 1, int(depth.min()) - 1, -1):
            character = words[start + places[j]].astype(np.uint64)
            path = character[first][group]
            differs = np.flatnonzero(character != path)
            leaves[differs], branch[differs], greater[differs] = j, character[differs], character[differs] > path[differs]
        # per group: smaller branches by depth, the path itself at ``end``, greater ones by depth upwards
        turn = group * (2 * end + 2) + np.where(greater, 2 * end - leaves, leaves)
        by = np.lexsort((branch, turn))
        order[slot] = order[slot][by]
        turn, branch, leaves = turn[by], branch[by], leaves[by]
        heads = np.flatnonzero(np.concatenate([[True], (turn[1:] != turn[:-1]) | (branch[1:] != branch[:-1])]))
        on_path = leaves == end
        again = on_path.copy()
        again[heads] = False
        equal.append(slot[again])
        size = np.diff(np.append(heads, len(slot)))
        size[on_path[heads]] = 1
        low, depth = slot[heads], leaves[heads] + 1
    return np.concatenate(equal)


def deep_shallow(text: np.ndarray, starts: np.ndarray, length: int = WINDOW, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at ``starts`` by their first ``length`` bytes, and for each place in the order whether the
    suffix there equals the one before it over that length. Every suffix has ``length`` bytes; ``length`` is 16 at least. A
    character is 8 bytes."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((len(text) + 1,), dtype=">u8", buffer=padded, strides=(1,))
    places = [*range(0, length - 7, 8)]
    if places[-1] != length - 8:
        places.append(length - 8)  # the last 8 bytes, overlapping the ones before
    order, low, size = _multikey_quicksort(words, starts, places[: shallow // 8])
    same = np.zeros(len(starts), bool)
    same[_blind_tries(words, starts, places[shallow // 8 :], order, low, size)] = True
    return order, same


def earlier_windows(lengths: np.ndarray, keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Per stretch, a bit for each of its windows: whether a stretch with a smaller key has the same window."""
    begins = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[:-1]
    windows = lengths.astype(np.int64) - WINDOW + 1
    owner = np.repeat(np.arange(len(lengths)), windows)
    bit = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    order, same = deep_shallow(text, begins[owner] + bit)
    heads = np.flatnonzero(~same)
    if not len(heads):
        return np.zeros(len(lengths), np.uint32)
    sorted_keys = keys[owner[order]]
    least = np.repeat(np.minimum.reduceat(sorted_keys, heads), np.diff(np.append(heads, len(order))))
    hit = order[least < sorted_keys]
    out = np.zeros(len(lengths), np.uint32)
    np.bitwise_or.at(out, owner[hit], np.uint32(1) << bit[hit].astype(np.uint32))
    return out


def _planes(keys: np.ndarray) -> np.ndarray:
    step = np.diff(keys, prepend=np.uint64(0))
    return np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).reshape(-1)


def _unplanes(planes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).reshape(-1), dtype=np.uint64)


def _anchors(chunked: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, blob): a chunk's distinct anchors, and for each whether two of its documents have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(chunk, held):
            keys = np.concatenate([h[0] for h in held])
            docs = np.concatenate([h[1] for h in held])
            order = np.argsort(keys, kind="stable")
            keys, docs = keys[order], docs[order]
            heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
            if not len(heads):
                return
            several = np.minimum.reduceat(docs, heads) != np.maximum.reduceat(docs, heads)
            keys = keys[heads]
            low, high = to_buckets(keys, buckets)
            for b in range(buckets):
                if high[b] > low[b]:
                    blob = squeeze(_planes(keys[low[b] : high[b]]), np.packbits(several[low[b] : high[b]]))
                    yield pa.record_batch([pa.array([b], pa.int32()), pa.array([chunk], pa.int64()), pa.array([blob], pa.binary())], names=["bucket", "chunk", "blob"])

        now, held, base = None, [], 0
        for batch in batches:
            for chunk, part in runs(batch):
                if held and chunk != now:
                    yield from out(now, held)
                    held, base = [], 0
                    release()
                now = chunk
                data, offsets = flat(part.column(2))
                for a, _, s in _stretches_of(data, offsets):
                    held.append((s.anchor, s.doc + (base + a)))
                base += part.num_rows
        if held:
            yield from out(now, held)
        held = []
        release()

    return chunked.mapInArrow(run, "bucket int, chunk long, blob binary")


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket and chunk, one bit for each of the chunk's anchors: whether more than one document has it."""
    for (bucket,), rows in grouped(batches):
        chunks, keys, several = [], [], []
        for _, chunk, blob in rows:
            planes, bits = expand(blob)
            keys.append(_unplanes(planes))
            several.append(np.unpackbits(bits, count=len(keys[-1])).astype(bool))
            chunks.append(chunk)
        distinct, place, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        shared = times > 1
        shared[place[np.concatenate(several)]] = True
        by_chunk: dict[int, list[np.ndarray]] = {}
        for chunk, own in zip(chunks, keys, strict=True):
            by_chunk.setdefault(chunk, []).append(own)
        for chunk, parts in by_chunk.items():
            own = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            bits = shared[np.searchsorted(distinct, own)]
            blob = squeeze(np.packbits(bits), np.array([len(bits)], "<i8"))
            yield pa.record_batch([pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], names=["chunk", "kind", "blob"])


class _Chunk:
    """A chunk's texts with its candidate stretches: those of shared anchors, each distinct one once."""

    def __init__(self, flags: list[bytes], texts: list[bytes]):
        self.parts = [texts_of(t) for t in texts]
        bits = []
        for f in flags:
            packed, count = expand(f)
            bits.append(np.unpackbits(packed, count=int(count[0])).astype(bool))
        shared = np.concatenate(bits) if bits else np.zeros(0, bool)
        found = []
        for p, (_, data, offsets) in enumerate(self.parts):
            for a, base, s in _stretches_of(data, offsets):
                found.append((s.anchor, s.text, s.low + base, s.end - s.low, s.doc + a, np.full(len(s.low), p)))
        columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.uint64 if i < 2 else np.int64) for i in range(6)]
        if len(columns[0]):
            distinct, place = np.unique(columns[0], return_inverse=True)
            if len(distinct) != len(shared):
                raise RuntimeError("a chunk changed between two passes")
            keep = shared[place]
            columns = [c[keep] for c in columns]
        self.anchor, self.hash, self.low, self.length, self.doc, self.part = columns
        keys = [p[0].fill_null(_LAST_KEY).to_numpy(zero_copy_only=False).astype(np.int64) for p in self.parts]
        first = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64)
        every = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.key = every[first[self.part] + self.doc] if len(self.part) else np.zeros(0, np.int64)
        order = np.lexsort((self.key, self.length, self.hash, self.anchor))
        same = np.zeros(len(order), bool)
        a, h, n = self.anchor[order], self.hash[order], self.length[order]
        same[1:] = (a[1:] == a[:-1]) & (h[1:] == h[:-1]) & (n[1:] == n[:-1])
        at = np.flatnonzero(same)
        same[at] = self._equal(order[at - 1], order[at])
        self.heads = order[~same]  # of each distinct stretch, the occurrence with the smallest key
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(~same) - 1


    def _equal(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the stretches x and y, of equal lengths, have the same bytes, compared 8 at a time."""
        if not len(x):
            return np.zeros(0, bool)
        base = np.concatenate([[0], np.cumsum([len(p[1]) for p in self.parts])])
        text = np.concatenate([*[p[1] for p in self.parts], np.zeros(8, np.uint8)])
        words = np.ndarray((len(text) - 7,), dtype="<u8", buffer=text, strides=(1,))
        one, two = (self.low[i] + base[self.part[i]] for i in (x, y))
        last, same = self.length[x] - 8, np.ones(len(x), bool)
        for at in range(0, int(last.max()) + 8, 8):
            step = np.minimum(at, last)
            same &= words[one + step] == words[two + step]
        return same


def _candidates(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (chunk_id,), rows in grouped(batches):
            flags, texts = [], []
            for _, kind, blob in rows:
                (texts if kind == TEXTS else flags).append(blob)
            if not flags or not texts:
                continue
            chunk = _Chunk(flags, texts)
            heads = chunk.heads
            low, high = to_buckets(chunk.anchor[heads], buckets)
            for b in range(buckets):
                own = heads[low[b] : high[b]]
                if not len(own):
                    continue
                at = np.repeat(chunk.low[own] - (np.cumsum(chunk.length[own]) - chunk.length[own]), chunk.length[own]) + np.arange(int(chunk.length[own].sum()))
                part = np.repeat(chunk.part[own], chunk.length[own])
                text = np.empty(len(at), np.uint8)
                for p in np.unique(part):
                    pick = part == p
                    text[pick] = chunk.parts[p][1][at[pick]]
                blob = squeeze(_planes(chunk.anchor[own]), chunk.length[own].astype("u1"), chunk.key[own].astype("<i8"), text)
                yield pa.record_batch([pa.array([b], pa.int32()), pa.array([chunk_id], pa.int64()), pa.array([blob], pa.binary())], names=["bucket", "chunk", "blob"])

    return run


def _sorted_buckets(batches: Iterator[pa.RecordBatch], at_once: int = 60_000) -> Iterator[pa.RecordBatch]:
    """Per bucket and chunk: the earlier windows of each of the chunk's stretches. Stretches of one anchor are sorted together,
    some tens of thousands of stretches at a time."""
    for (bucket,), rows in grouped(batches):
        chunks, anchors, lengths, keys, texts = [], [], [], [], []
        for _, chunk, blob in rows:
            planes, length, key, text = expand(blob)
            chunks.append(chunk)
            anchors.append(_unplanes(planes))
            lengths.append(length.astype(np.int64))
            keys.append(key)
            texts.append(text)
        anchor, length, key, text = (np.concatenate(x) for x in (anchors, lengths, keys, texts))
        del anchors, texts
        begin = np.cumsum(length) - length
        order = np.argsort(anchor, kind="stable")
        sorted_ = anchor[order]
        masks = np.zeros(len(anchor), np.uint32)
        at = 0
        while at < len(order):
            to = min(at + at_once, len(order))
            to = int(np.searchsorted(sorted_, sorted_[to - 1], side="right"))
            own = order[at:to]
            n = length[own]
            place = np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            masks[own] = earlier_windows(n, key[own], text[place])
            at = to
        edges = np.cumsum([0] + [len(x) for x in lengths])
        for i, chunk in enumerate(chunks):
            blob = squeeze(masks[edges[i] : edges[i + 1]].astype("<u4"))
            yield pa.record_batch([pa.array([chunk], pa.int64()), pa.array([(1 << 24) + bucket], pa.int32()), pa.array([blob], pa.binary())], names=["chunk", "kind", "blob"])


def _cover(key: str, columns: list[str] | None = None, text: str = ""):
    """The last pass. With ``columns``, rows of those come out, the others as they were carried and ``text`` without its repeats."""


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches):
            flags, masks, texts = [], [], []
            for _, kind, blob in rows:
                (texts if kind == TEXTS else masks if kind >= 1 << 24 else flags).append(blob)
            if not texts:
                continue
            chunk = _Chunk(flags, texts)
            mask = np.concatenate([expand(m)[0] for m in masks]) if masks else np.zeros(0, np.uint32)
            if len(mask) != len(chunk.heads):
                raise RuntimeError("a chunk changed between two passes")
            bits = mask[chunk.of] if len(mask) else np.zeros(0, np.uint32)
            # a later occurrence of the same stretch has all of it in an earlier document
            bits = np.where(chunk.key > chunk.key[chunk.heads][chunk.of], np.uint32(0xFFFFFFFF), bits) if len(mask) else bits
            for p, (names, data, offsets) in enumerate(chunk.parts):
                others = others_of(texts[p]) if columns else None
                step = np.zeros(len(data) + 1, np.int32)
                own = np.flatnonzero((chunk.part == p) & (bits != 0))
                windows = chunk.length[own] - WINDOW + 1
                for j in range(int(windows.max(initial=0))):
                    hit = own[(windows > j) & ((bits[own] >> np.uint32(j)) & np.uint32(1)).astype(bool)]
                    np.add.at(step, chunk.low[hit] + j, 1)
                    np.add.at(step, chunk.low[hit] + j + WINDOW, -1)
                gone = np.cumsum(step[:-1]) > 0
                edge = gone.copy()
                edge[1:] &= ~gone[:-1]
                inner = offsets[:-1][offsets[:-1] < len(data)]
                edge[inner] = gone[inner]
                begins = np.flatnonzero(edge)
                last = gone.copy()
                last[:-1] &= ~gone[1:]
                tail = offsets[1:][offsets[1:] > 0] - 1
                last[tail] = gone[tail]
                ends = np.flatnonzero(last) + 1
                removed = np.concatenate([[0], np.cumsum(gone)])
                first = np.searchsorted(begins, offsets)
                for a in range(0, len(names), 256):
                    b = min(a + 256, len(names))
                    lists = pa.ListArray.from_arrays(pa.array((first[a : b + 1] - first[a]).astype(np.int32)), pa.array(begins[first[a] : first[b]] - np.repeat(offsets[a:b], np.diff(first[a : b + 1]))))
                    stops = pa.ListArray.from_arrays(pa.array((first[a : b + 1] - first[a]).astype(np.int32)), pa.array(ends[first[a] : first[b]] - np.repeat(offsets[a:b], np.diff(first[a : b + 1]))))
                    kept = [data[offsets[i] : offsets[i + 1]][~gone[offsets[i] : offsets[i + 1]]].tobytes() for i in range(a, b)]
                    if columns:
                        left = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
                        rest = iter(others.slice(a, b - a).columns)
                        yield pa.record_batch([left if c == text else next(rest) for c in columns], names=columns)
                        continue
                    yield pa.record_batch(
                        [names.slice(a, b - a), pa.array(np.diff(offsets[a : b + 1])), pa.array(np.diff(removed[offsets[a : b + 1]])), lists, stops, pa.array(kept, pa.binary())],
                        names=[key, "n_bytes", "n_removed", "starts", "ends", "kept"],
                    )

    return run


def _removal(docs: DataFrame, key: str, text: str, rows: int, carry: bool) -> DataFrame:
    n = partitions(docs.sparkSession)
    chunked = with_chunks(docs, key, text, rows, carry)
    plain = chunked.select("chunk", "key", "text")
    anchors = dealt(_anchors(plain, n), n, "bucket", "chunk")
    flags = written(anchors.mapInArrow(_shared_anchors, "chunk long, kind int, blob binary"), "shared-anchors")
    met = dealt(flags.unionByName(text_blobs(plain)), n, "chunk", "kind")
    candidates = met.mapInArrow(_candidates(n), "bucket int, chunk long, blob binary")
    candidates = dealt(candidates, n, "bucket", "chunk")
    masks = written(candidates.mapInArrow(_sorted_buckets, "chunk long, kind int, blob binary"), "earlier-windows")
    met = dealt(flags.unionByName(masks).unionByName(text_blobs(chunked)), n, "chunk", "kind")
    if carry:
        return met.mapInArrow(_cover(key, docs.columns, text), StructType([StructField(f.name, f.dataType) for f in docs.schema.fields]))
    return met.mapInArrow(_cover(key), f"`{key}` long, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept binary")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = ROWS) -> DataFrame:
    """(key, n_bytes, n_removed, starts, ends, kept): per row, the removed byte ranges (ends past the last byte) and what stays.

    A null text is an empty one. Of repeated rows with one key none is earlier than another. A null key comes after all
    others. Texts under 50 bytes stay whole. Other columns are ignored. An empty table gives an empty result.
    """
    return _removal(docs, key, text, rows, False)


def dedup_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = ROWS) -> DataFrame:
    """All rows and columns of ``docs``, each text without its repeats. A character that a removed range cuts goes as a whole; a
    null text becomes empty; a text that is all repeats is empty and its row stays. Other columns travel in Arrow's own
    format and come back as they were."""
    return _removal(docs, key, text, rows, True)
