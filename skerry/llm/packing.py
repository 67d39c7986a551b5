"""Best-fit packing by exact-complement hashing.

Packing depends on lengths alone, and a length is at most the capacity: the whole corpus is a histogram of at most 2048
counts, whatever its size. The driver plans over that histogram; documents never leave the executors. The plan takes the
longest length left, looks its gap up in indexes of single lengths, pair sums and triple sums, and uses a combination
that fills the gap exactly as often as the counts allow; what has no exact complement is filled best-fit, largest first,
looking for an exact complement again after each piece. Each choice is a template with a number of copies, so a plan has
thousands of entries for billions of documents. Pieces then get their rank within their length and read their place off
the template that holds this rank.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm._shared import written

CAPACITY = 2048
END_ID = 0


@dataclass
class Plan:
    """Templates: lengths in order, and how many sequences are filled that way."""

    templates: list[tuple[tuple[int, ...], int]]

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.templates)


class _Counts:
    """Available lengths, and the index of exact complements of up to three pieces.

    The index is two bit sets over lengths, one of them mirrored: shifted against each other by a gap and intersected,
    they hold every pair with that sum. Triples are a first length and the pair entry of the rest.
    """

    def __init__(self, counts: np.ndarray, balanced: bool):
        self.n = [0, *(int(x) for x in counts[1:])]
        self.top = len(self.n)
        self.balanced = balanced
        self.bits = sum(1 << i for i, x in enumerate(self.n) if x)
        self.mirror = sum(1 << (self.top - i) for i, x in enumerate(self.n) if x)

    def add(self, length: int, k: int) -> None:
        before, self.n[length] = self.n[length], self.n[length] + k
        if (before > 0) != (self.n[length] > 0):
            self.bits ^= 1 << length
            self.mirror ^= 1 << (self.top - length)

    def largest(self, gap: int) -> int:
        """The longest available length up to the gap, or 0."""
        return max((self.bits & ((1 << (gap + 1)) - 1)).bit_length() - 1, 0)

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.n[gap] > 0 else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        half = gap // 2
        found = self.bits & (self.mirror >> (self.top - gap)) & ((1 << (half + 1)) - 1)
        if gap % 2 == 0 and self.n[half] == 1:
            found &= ~(1 << half)
        if not found:
            return None
        low = (found.bit_length() if self.balanced else (found & -found).bit_length()) - 1
        return (gap - low, low)

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """Three lengths, the first of them as long as can be or, if balanced, from a third of the gap upwards."""
        left = self.bits & ((1 << max(gap - 1, 0)) - 1)
        order = range(-(-gap // 3), gap - 1) if self.balanced else range(left.bit_length() - 1, 0, -1)
        for a in order:
            if not left >> a & 1:
                continue
            self.add(a, -1)
            rest = self.pair(gap - a)
            self.add(a, 1)
            if rest:
                return (a, *rest)
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        return self.single(gap) or self.pair(gap) or self.triple(gap)

    def take(self, pieces: list[int]) -> int:
        """As many copies of the combination as the counts allow; they are used up."""
        need = Counter(pieces)
        k = min(self.n[length] // n for length, n in need.items())
        for length, n in need.items():
            self.add(length, -k * n)
        return k


def _plan(counts: np.ndarray, capacity: int, balanced: bool) -> Plan:
    left = _Counts(counts, balanced)
    templates: list[tuple[tuple[int, ...], int]] = []
    while length := left.largest(capacity):
        pieces, gap = [length], capacity - length
        left.add(length, -1)
        while gap:
            chosen = left.exact(gap)
            if chosen is None:
                fitting = left.largest(gap)
                if not fitting:
                    break
                chosen = (fitting,)
            for piece in chosen:
                left.add(piece, -1)
            pieces += chosen
            gap -= sum(chosen)
        for piece in pieces:  # one copy was only set aside; now as many as the counts allow are used
            left.add(piece, 1)
        templates.append((tuple(pieces), left.take(pieces)))
    return Plan(templates)


def best_fit_plan(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """The better of two orders of the index entries: balanced complements, or the longest piece first."""
    plans = [_plan(counts, capacity, balanced) for balanced in (False, True)]
    return min(plans, key=lambda p: p.sequences)


class Encoder:
    """Token ids by the ``tokenizers`` library's file. Texts of Latin letters go through ``tiktoken`` on the rank file of
    the same vocabulary, which gives the same ids several times faster; all others through the library itself.

    With ``added`` a text that spells out a token added to the vocabulary gets that token's id, as the library does by
    default; without, the token's letters are encoded like any others."""

    def __init__(self, file: str, ranks: str | None = None, added: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.library.encode_special_tokens = not added
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()] if added else []
        self.fast = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and (text.isascii() or max(text) < "ɐ") and not any(t in text for t in self.added):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


def pieces_of(total: int, capacity: int = CAPACITY) -> Iterator[tuple[int, int]]:
    """(start, length) of each piece: only what is longer than the capacity is cut, and only the first piece may be shorter."""
    first = total % capacity or capacity if total > capacity else total
    yield 0, first
    for start in range(first, total, capacity):
        yield start, capacity


def tokenised(docs: DataFrame, file: str, ranks: str | None, key: str, text: str, capacity: int, added: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32, part, seq): ``seq`` numbers a task's pieces of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder(file, ranks, added), TaskContext.get().partitionId()
        used = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encoder.ids(body or ""), np.uint32(END_ID)).astype("<u4")
                for i, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                    rows.append((name, i, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, int(used[length])))
                    used[length] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "piece", "start", "length", "ids_crc32", "part", "seq"])

    schema = "key long, piece int, start long, length long, ids_crc32 long, part int, seq long"
    return docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, file: str, ranks: str | None = None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, added: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row.

    A null text is empty and is one piece of one token; repeated rows are packed as often as they come; rows with a null
    key are packed too; ``added`` is that of ``Encoder``; other columns are ignored. Sequences are filled from offset 0 without gaps. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = written(tokenised(docs, file, ranks, key, text, capacity, added), "pieces")
    per_part = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for row in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row per length: at most ``capacity``
        counts[row.length] = row.n
    plan = best_fit_plan(counts, capacity)
    slots, sequence, used = [], 0, np.zeros(capacity + 1, np.int64)
    for lengths, copies in plan.templates:
        offset = 0
        for length in lengths:
            slots.append((length, int(used[length]), sequence, offset))
            used[length] += copies
            offset += length
        sequence += copies
    table = np.array(sorted(slots), np.int64).reshape(-1, 4)  # bounded by the number of templates times the pieces in one
    places = spark.sparkContext.broadcast(table)
    span = int(counts.max(initial=0)) + 1
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # a row per task and length: it grows with the input, so it is never broadcast
    ranked = pieces.join(offsets.hint("merge"), ["part", "length"]).select("key", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("seq")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = places.value
        heads = t[:, 0] * span + t[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            at = np.searchsorted(heads, length * span + rank, side="right") - 1
            sequence_id = t[at, 2] + rank - t[at, 1]
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence_id), pa.array(t[at, 3])], names=[key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"`{key}` long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
