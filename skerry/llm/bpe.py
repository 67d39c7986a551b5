"""Byte-level BPE by Spark's higher-order functions over distinct words.

Words (matches of the pattern) repeat; merges depend on the word alone. So each chunk of documents sends its distinct
words that are not entries of the vocabulary themselves, bucketed by a hash, and each bucket folds the ranked merges over
the byte array of every distinct word once, in Spark expressions: the state is the array of pieces and the array of ranks
of neighbouring pairs, and a step joins the leftmost pair of lowest rank. Ranks come from a literal rank map: a cuckoo hash
table keyed by the ids of both pieces, because a lookup in a Spark map reads all its keys. In a long word a step joins all
pairs of lowest rank at once where that cannot change the result, so a run of a million equal bytes takes tens of steps.
Buckets answer each chunk with the ids of its words, and the chunk's documents are put together from them. Words are told
apart by their bytes, never by a hash. Decoding joins the binary piece of each id, again in Spark.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm._chunks import ROWS, TEXTS, dealt, expand, grouped, portions, release, runs, squeeze, text_blobs, texts_of, with_chunks
from skerry.llm._shared import partitions
from skerry.llm._text import flat, xxh64

#: Bytes of a word up to which a step joins one pair; in longer ones it joins all pairs of one rank.
SHORT = 64
_WORDS_A_ROW = 2048
#: Odd sizes of the two halves of the rank table are looked for from this many slots an entry on.
_ROOM = 1.3

# White space as the pattern means it, and the pattern with that class spelled out.
SPACE = "\t-\r \x85\xa0  -     　"
_LATIN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^{SPACE}\w]|_)+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_OTHER_NUMBERS = re.compile("[²³¹¼½¾]")


def read_ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def splitter():
    """text -> its words: the pattern's matches. Latin texts go through the standard library's faster engine."""
    import regex

    full = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

    def split(text: str) -> list[str]:
        if text.isascii() or (max(text) < "ɐ" and not _OTHER_NUMBERS.search(text)):
            return _LATIN.findall(text)
        return full.findall(text)

    return split


def _cuckoo(keys: list[int]) -> tuple[list[int | None], list[int | None]]:
    """Two tables such that each key stands in the first at key % size, or in the second at key % size."""
    size = int(_ROOM * len(keys)) | 1
    while True:
        sizes = (size, size + 2)
        tables: tuple[list[int | None], ...] = ([None] * sizes[0], [None] * sizes[1])
        for key in keys:
            side, now = 0, key
            for _ in range(500):
                slot = now % sizes[side]
                tables[side][slot], now = now, tables[side][slot]
                if now is None:
                    break
                side = 1 - side
            else:
                break
        else:
            return tables
        size = int(size * 1.2) | 1


def rank_table(ranks: dict[bytes, int]) -> Column:
    """The rank map as one foldable literal: ids of single bytes, and for both halves of the table the pairs of ids and their ranks."""
    bits = _width(ranks)
    pairs = {ranks[p[:i]] << bits | ranks[p[i:]]: r for p, r in ranks.items() for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks}
    halves = _cuckoo(list(pairs))
    table = {"b": [ranks.get(bytes([x])) for x in range(256)]}
    for name, half in zip("xy", halves, strict=True):
        table |= {f"{name}k": half, f"{name}r": [None if k is None else pairs[k] for k in half], f"{name}n": len(half)}
    schema = "b array<int>, xk array<bigint>, xr array<int>, xn int, yk array<bigint>, yr array<int>, yn int"
    return F.from_json(F.lit(json.dumps(table, separators=(",", ":"))), f"struct<{schema.replace(' ', ':').replace(',:', ',')}>")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


class _Ranks:
    """Expressions over the rank table ``t``, which is bound once."""

    def __init__(self, t: Column, bits: int):
        self.t, self.bits = t, bits

    def key(self, a: Column, b: Column) -> Column:
        return F.shiftleft(a.cast("long"), self.bits).bitwiseOR(b.cast("long"))

    def of(self, k: Column) -> Column:
        """The rank of a pair of ids given as its key, or null; ``k`` is best a variable, as it is read several times."""
        t = self.t
        x, y = (k % t["xn"]).cast("int"), (k % t["yn"]).cast("int")
        return F.when(F.get(t["xk"], x) == k, F.get(t["xr"], x)).when(F.get(t["yk"], y) == k, F.get(t["yr"], y))


def _short_fold(word: Column, ranks: _Ranks) -> Column:
    """The fold of a word of at most SHORT bytes. A piece is one number: the rank of its pair with the next piece, where it
    starts, and its id; so the least number is the leftmost pair of lowest rank."""
    bits, place = ranks.bits, (SHORT - 1).bit_length()
    none, mask = 1 << bits, (1 << bits) - 1
    id_of = lambda x: x.bitwiseAND(F.lit(mask))

    def paired(a: Column, b: Column) -> Column:
        rank = _let(ranks.key(a, b), lambda k: F.coalesce(ranks.of(k), F.lit(none)).cast("long"))
        return F.shiftleft(F.coalesce(rank, F.lit(none).cast("long")), bits + place)

    def step(pieces: Column) -> Column:
        def join(m: Column) -> Column:
            rank = F.shiftright(m, bits + place)

            def at(i: Column) -> Column:  # i: the left piece, from 1
                left = paired(F.get(pieces, i - 2).bitwiseAND(F.lit(mask)), rank).bitwiseOR(F.get(pieces, i - 2).bitwiseAND(F.lit((1 << bits + place) - 1)))
                own = paired(rank, id_of(F.get(pieces, i + 1))).bitwiseOR(m.bitwiseAND(F.lit(((1 << place) - 1) << bits))).bitwiseOR(rank)
                new = F.transform(pieces, lambda x, j: F.when(j == i - 1, own).when(j == i, F.lit(-1).cast("long")).when(j == i - 2, left).otherwise(x))
                return F.filter(new, lambda x: x >= 0)

            return F.when(rank >= none, pieces).otherwise(_let(F.array_position(pieces, m).cast("int"), at))

        return _let(F.array_min(pieces), join)

    ids = F.transform(word, lambda b: F.get(ranks.t["b"], b))
    start = _let(ids, lambda p: F.transform(p, lambda x, i: paired(x, F.get(p, i + 1)).bitwiseOR(F.shiftleft(i.cast("long"), bits)).bitwiseOR(x.cast("long"))))
    return F.aggregate(word, start, lambda pieces, _: step(pieces), lambda pieces: F.transform(pieces, lambda x: id_of(x).cast("int")))


def _long_fold(word: Column, ranks: _Ranks) -> Column:
    """The fold of a longer word. ``r`` has one place more than ``p``: r[i] is the rank of the pair p[i - 1], p[i], or null."""
    key, rank = ranks.key, ranks.of

    def ranks_of(p: Column) -> Column:
        keys = F.transform(p, lambda x, i: key(F.get(p, i - 1), x))
        return F.concat(F.transform(keys, rank), F.array(F.lit(None).cast("int")))

    def one(p: Column, r: Column, m: Column) -> Column:
        def at(i: Column) -> Column:  # i: the place of the pair in r, from 1
            around = F.transform(F.array(key(F.get(p, i - 3), m), key(m, F.get(p, i))), rank)
            return F.struct(
                F.concat(F.slice(p, F.lit(1), i - 2), F.array(m), F.slice(p, i + 1, F.size(p))).alias("p"),
                F.concat(F.slice(r, F.lit(1), i - 2), around, F.slice(r, i + 2, F.size(r))).alias("r"),
            )

        return _let(F.array_position(r, m).cast("int"), at)

    def every(p: Column, r: Column, m: Column) -> Column:
        """All pairs of rank m that do not overlap, from the left; of several runs of overlapping ones, the first of each."""
        here = lambda i: F.get(r, i).eqNullSafe(m)
        starts = F.filter(F.sequence(F.lit(1), F.size(p)), lambda i: here(i) & ~here(i - 1))

        def chosen(s: Column) -> Column:
            alone, first = F.size(s) == 1, F.get(s, 0)
            taken = lambda i: here(i) & F.when(alone, (i - first) % 2 == 0).otherwise(~here(i - 1))
            joined = F.filter(F.transform(p, lambda x, i: F.when(taken(i + 1), m).when(taken(i), F.lit(-1)).otherwise(x)), lambda x: x >= 0)
            return _let(joined, lambda q: F.struct(q.alias("p"), ranks_of(q).alias("r")))

        return _let(starts, chosen)

    def lower(p: Column, r: Column, m: Column) -> Column:
        """Whether joining some pair of rank m makes a pair of lower rank, which would have to come before the next of rank m."""
        below = lambda k: F.coalesce(rank(k) < m, F.lit(False))
        beside = lambda i: below(key(m, F.get(p, i + 1))) | below(key(F.get(p, i - 2), m))
        return below(key(m, m)) | F.exists(F.sequence(F.lit(1), F.size(p)), lambda i: F.get(r, i).eqNullSafe(m) & beside(i))

    def step(state: Column) -> Column:
        p, r = state["p"], state["r"]
        join = lambda m: F.when(m.isNull(), state).otherwise(F.when(lower(p, r, m), one(p, r, m)).otherwise(every(p, r, m)))
        return _let(F.array_min(r), join)

    start = _let(F.transform(word, lambda b: F.get(ranks.t["b"], b)), lambda p: F.struct(p.alias("p"), ranks_of(p).alias("r")))
    return F.aggregate(F.sequence(F.lit(1), F.size(word)), start, lambda state, _: step(state), lambda state: state["p"])


def fold_ids(word: Column, t: Column, bits: int) -> Column:
    """array<int> of the ids of a word given as an array of its bytes (0 to 255, one at least); ``t`` is the rank table, bound
    once, and ``bits`` the width of an id."""
    ranks = _Ranks(t, bits)
    return F.when(F.size(word) <= SHORT, _short_fold(word, ranks)).otherwise(_long_fold(word, ranks))


def _width(ranks: dict[bytes, int]) -> int:
    return max(max(ranks.values(), default=0).bit_length(), 1)


def word_ids(word: Column, ranks: dict[bytes, int]) -> Column:
    """array<int> of a word's ids: ``word`` is a string with one character for each byte and at least one."""
    return _let(rank_table(ranks), lambda t: fold_ids(F.transform(F.split(word, ""), lambda c: F.ascii(c)), t, _width(ranks)))


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The binary pieces of an array of ids, joined; a byte is a character U+0000 to U+00FF on the way."""
    names: list[str | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        names[rank] = piece.decode("latin-1")
    pieces = F.from_json(F.lit(json.dumps(names)), "array<string>")
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""), "ISO-8859-1")


def merged_ids(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap, on the driver: what the fold is held against in tests."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), [i + 1 for i in range(n)]
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


# Classes of bytes in texts of ASCII and Latin letters: white space, letters, digits, all else.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[0x30:0x3A] = 2
#: First bytes of characters that are not all letters; texts with any of them are split by the pattern itself.
_FOREIGN = np.zeros(256, bool)
_FOREIGN[[0xC2, *range(0xC9, 0x100)]] = True


def token_starts(data: np.ndarray, offsets: np.ndarray, split) -> np.ndarray:
    """Where the pattern's matches start. Matches leave no gaps, so these are all bounds there are.

    For Latin texts the pattern comes down to neighbouring bytes: a match starts where the class changes, the last white
    space before a word starts the word's match if it is a space and is a match of its own if not, and an apostrophe that
    starts a match takes the ending of a contraction.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    head = np.zeros(n + 1, bool)
    head[offsets[:-1]] = True
    head[n] = True
    kind = _CLASS[data]
    before = np.empty(n, np.uint8)
    before[1:] = kind[:-1]
    before[0] = 0
    after = np.empty(n, np.uint8)
    after[:-1] = kind[1:]
    after[-1] = 0
    after[head[1:]] = 0  # nothing follows the last byte of a text
    blank = kind == 0
    spaced = np.zeros(n, bool)
    spaced[1:] = data[:-1] == 0x20
    start = np.where(blank, (before != 0) | (after != 0), ((before != 0) & (before != kind)) | ((before == 0) & ~spaced))
    start |= head[:-1]
    at = np.flatnonzero((data == 0x27) & start)
    if len(at):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        one, two = padded[at + 1], padded[at + 2]
        same1, same2 = ~head[np.minimum(at + 1, n)], ~head[np.minimum(at + 1, n)] & ~head[np.minimum(at + 2, n)]
        short = same1 & np.isin(one, list(b"stmd"))
        long = same2 & (((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C)))
        for hit, size in ((short, 2), (long & ~short, 3)):
            q = at[hit]
            start[q + 1] = False
            end = q + size
            start[end[end < n]] = True
    odd = _FOREIGN[data]
    odd[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    strange = np.unique(np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1)
    for d in strange:
        a, b = int(offsets[d]), int(offsets[d + 1])
        sizes = [len(w.encode()) for w in split(data[a:b].tobytes().decode())]
        start[a:b] = False
        start[a + np.cumsum([0, *sizes])[:-1]] = True
    return np.flatnonzero(start)


def _tokens(data: np.ndarray, offsets: np.ndarray, split) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Where each match starts, and the matches as places in the dictionary of distinct ones, by their bytes."""
    starts = token_starts(data, offsets, split)
    bounds = np.append(starts, len(data)).astype(np.int64)
    matches = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    return starts, matches.dictionary_encode()


def _gather(values: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs ``values[begin : begin + count]``, one after the other."""
    total = int(counts.sum())
    return values[np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(total)]


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and bytes of a binary array."""
    data, offsets = flat(words)
    return np.diff(offsets), data


def _words_from(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])


class _Vocabulary:
    """Ids of words that are entries themselves, and the order in which a chunk's other words are asked for and answered."""

    def __init__(self, ranks: dict[bytes, int], buckets: int):
        self.pieces, self.buckets = pa.array(list(ranks), pa.large_binary()), buckets
        self.ids = np.array(list(ranks.values()), np.int64)

    def whole(self, words: pa.Array) -> np.ndarray:
        """The id of each word, or -1."""
        if not len(self.pieces):
            return np.full(len(words), -1)
        at = pc.index_in(words, value_set=self.pieces).fill_null(-1).to_numpy(zero_copy_only=False)
        return np.where(at >= 0, self.ids[at], -1)

    def order(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The order of distinct words by bucket and bytes, and the bucket of each in that order."""
        by_bytes = pc.sort_indices(words).to_numpy()
        lengths, data = _bytes_of(words)
        ends = np.cumsum(lengths)
        bucket = (xxh64(data, ends - lengths, ends) % np.uint64(self.buckets)).astype(np.int64)[by_bytes]
        by_bucket = np.argsort(bucket, kind="stable")
        return by_bytes[by_bucket], bucket[by_bucket]


def _words_of_chunks(chunked: DataFrame, ranks: dict[bytes, int], buckets: int) -> DataFrame:
    """(bucket, chunk, blob): lengths and bytes of the distinct words of each chunk that are no entries, in the order of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, vocabulary = splitter(), _Vocabulary(ranks, buckets)

        def out(chunk: int, held: list[pa.Array]) -> Iterator[pa.RecordBatch]:
            words = pa.chunked_array(held, pa.large_binary()).unique()
            order, bucket = vocabulary.order(words)
            lengths, data = _bytes_of(words.take(pa.array(order)))
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            at = np.concatenate([[0], np.cumsum(lengths)])
            for b in np.unique(bucket):
                a, z = edges[b], edges[b + 1]
                blob = squeeze(lengths[a:z].astype("<u4"), data[at[a] : at[z]])
                yield pa.record_batch([pa.array([int(b)], pa.int32()), pa.array([chunk], pa.int64()), pa.array([blob], pa.binary())], names=["bucket", "chunk", "blob"])

        now, held = None, []
        for batch in batches:
            for chunk, part in runs(batch):
                if chunk != now and held:
                    yield from out(now, held)
                    held = []
                    release()
                now = chunk
                data, offsets = flat(part.column(2))
                for a, b in portions(offsets):
                    words = _tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], split)[1].dictionary
                    held.append(words.filter(pa.array(vocabulary.whole(words) < 0)))
        if held:
            yield from out(now, held)
        held = []
        release()

    return chunked.mapInArrow(run, "bucket int, chunk long, blob binary")


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: rows of its distinct words as byte arrays, then each chunk's words as places among them."""
    kinds = {"bucket": pa.int32(), "chunk": pa.int64(), "words": pa.list_(pa.list_(pa.int16())), "blob": pa.binary()}

    def row(*values) -> pa.RecordBatch:
        return pa.record_batch([v if isinstance(v, pa.Array) else pa.array([v], t) for v, t in zip(values, kinds.values(), strict=True)], names=list(kinds))

    for (bucket,), rows in grouped(batches):
        by_chunk: dict[int, list[pa.Array]] = {}
        for _, chunk, blob in rows:
            by_chunk.setdefault(chunk, []).append(_words_from(*expand(blob)))
        # a chunk that two tasks share came twice: its words in the order of their bytes, each once
        own = [w[0] if len(w) == 1 else (lambda u: u.take(pc.sort_indices(u)))(pa.chunked_array(w).unique()) for w in by_chunk.values()]
        coded = pa.chunked_array(own).combine_chunks().dictionary_encode() if own else None
        lengths, data = _bytes_of(coded.dictionary)
        at = np.concatenate([[0], np.cumsum(lengths)])
        for a in range(0, len(lengths), _WORDS_A_ROW):
            z = min(a + _WORDS_A_ROW, len(lengths))
            inner = pa.ListArray.from_arrays(pa.array((at[a : z + 1] - at[a]).astype(np.int32)), pa.array(data[at[a] : at[z]].astype(np.int16)))
            yield row(bucket, None, pa.ListArray.from_arrays(pa.array([0, z - a], pa.int32()), inner), None)
        places, edge = coded.indices.to_numpy(), 0
        for chunk, words in zip(by_chunk, own, strict=True):
            yield row(bucket, chunk, None, squeeze(places[edge : edge + len(words)].astype("<u4")))
            edge += len(words)


def _answers(largest: int):
    kind = "<u2" if largest < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, known = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, chunk = (batch.column(c)[i].as_py() for c in (0, 1))
                if bucket != now:
                    now, held, known = bucket, [], None
                    release()
                if chunk is None:
                    ids = batch.column(2)[i].values
                    held.append((ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), ids.flatten().to_numpy(zero_copy_only=False).astype(kind)))
                    continue
                if known is None:
                    counts, ids = (np.concatenate([h[k] for h in held]) for k in range(2))
                    known, held = (counts, np.cumsum(counts) - counts, ids), []
                counts, begins, ids = known
                places = expand(batch.column(3)[i].as_py())[0]
                answer = squeeze(counts[places].astype("<u4"), _gather(ids, begins[places], counts[places]), level=3)
                yield pa.record_batch([pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), pa.array([answer], pa.binary())], names=["chunk", "kind", "blob"])

    return run


def encode(docs: DataFrame, ranks_file: str, key: str = "doc_id", text: str = "text", rows: int = ROWS) -> DataFrame:
    """(key, ids binary, decoded binary) per row: ids as little-endian unsigned 32-bit integers, and their decoding.

    A null text is an empty one and has no ids. Repeated rows and null keys stay. Other columns are ignored. An empty
    table gives an empty result. Words of any length go through the same fold. Memory: the distinct words of one chunk, or
    of one bucket, and the ids of one row.
    """
    ranks = read_ranks(ranks_file)
    n = partitions(docs.sparkSession)
    chunked = with_chunks(docs, key, text, rows)
    words = dealt(_words_of_chunks(chunked, ranks, n), n, "bucket", "chunk")
    words = words.mapInArrow(_distinct, "bucket int, chunk long, words array<array<smallint>>, blob binary")
    coded = words.select("bucket", "chunk", _let(rank_table(ranks), lambda t: F.transform("words", lambda w: fold_ids(w, t, _width(ranks)))).alias("ids"), "blob")
    answers = coded.mapInArrow(_answers(max(ranks.values(), default=0)), "chunk long, kind int, blob binary")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, vocabulary = splitter(), _Vocabulary(ranks, n)
        for _, rows_ in grouped(batches):
            answered, texts, parts = [], [], []
            for _, kind, blob in rows_:
                (texts if kind == TEXTS else answered).append(blob)
            for blob in texts:
                keys, data, offsets = texts_of(blob)
                for a, b in portions(offsets):
                    own = offsets[a : b + 1] - offsets[a]
                    starts, coded_ = _tokens(data[offsets[a] : offsets[b]], own, split)
                    parts.append((keys.slice(a, b - a), np.searchsorted(starts, own), coded_))
            del texts
            coded_ = pa.chunked_array([p[2] for p in parts]).unify_dictionaries()
            every = coded_.chunk(0).dictionary
            single = vocabulary.whole(every)
            asked = np.flatnonzero(single < 0)
            order = vocabulary.order(every.take(pa.array(asked)))[0]
            found = [expand(a) for a in answered]
            counts, ids = (np.concatenate([np.zeros(0, np.int64), *[f[i] for f in found]]).astype(np.int64) for i in range(2))
            if len(counts) != len(asked):
                raise RuntimeError("a chunk changed between two passes")
            # of each distinct word: where its ids begin, and how many there are; entries follow the answers
            count, begin = np.ones(len(every), np.int64), len(ids) + np.arange(len(every))
            count[asked[order]], begin[asked[order]] = counts, np.cumsum(counts) - counts
            ids = np.concatenate([ids, single]).astype("<u4")
            del answered, found
            for (keys, first_token, _), part in zip(parts, coded_.chunks, strict=True):
                at = part.indices.to_numpy()
                n_ids = count[at]
                own = _gather(ids, begin[at], n_ids)
                first = np.concatenate([[0], np.cumsum(n_ids)])[first_token]
                raw = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer((4 * first).astype("<i4")), pa.py_buffer(own)])
                tokens = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(own.view("<i4")))
                for a in range(0, len(keys), 64):
                    yield pa.record_batch([c.slice(a, 64) for c in (keys, raw, tokens)], names=[key, "ids", "tokens"])

    met = dealt(answers.unionByName(text_blobs(chunked)), n, "chunk", "kind")
    built = met.mapInArrow(build, f"`{key}` long, ids binary, tokens array<int>")
    return built.select(key, "ids", decoded(F.col("tokens"), ranks).alias("decoded"))
