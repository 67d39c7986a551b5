"""Exact top-k search: exhaustive term-at-a-time accumulation over a grid of queries and candidates.

A vector's dimensions are terms and its quantised components weights. In a block of candidates each dimension is a posting
list. For each term, the rows of the query matrix that have a weight there scatter weight times postings into a dense array
of 64-bit scores, query by candidate. The k best of a block come from partition selection, are merged with the best so far,
and only those leave the task; a window over at most k rows per query and cell merges the cells.

The grid has as few groups of queries as fit into memory (GROUP_BYTES each) and as many groups of candidates as there are
partitions left for them. A cell is one partition, dealt by its number: its queries stay resident while its candidates stream
past in blocks. So a candidate is copied once per group of queries and a query once per group of candidates, every pair meets
exactly once, and no side is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm._shared import partitions

SCALE = 1024
#: Bytes of the dense query matrix of one cell.
GROUP_BYTES = 32 << 20
#: Queries and candidates of one dense array of scores: a megabyte.
_QUERIES, _CANDIDATES = 64, 2048
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def quantised(x: float, scale: int = SCALE) -> int:
    """floor(scale * x) without rounding or overflow; ``scale`` is a power of two."""
    return math.floor(scale * x) if abs(x) < 1e300 else scale * int(x)


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Components of all vectors, and the n + 1 offsets between them."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])


def _dense(x: np.ndarray, offsets: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised vectors as rows of 64-bit integers, and which rows are too wide for that: their largest component can make
    scores of two such vectors leave 64 bits. Wide rows are zero."""
    lengths = np.diff(offsets)
    width = int(lengths.max(initial=0))
    limit = math.isqrt((1 << 62) // max(width, 1))
    row = np.repeat(np.arange(len(lengths)), lengths)
    wide = np.zeros(len(lengths), bool)
    wide[row[np.abs(x) >= limit // scale - 1]] = True
    out = np.zeros((len(lengths), width), np.int64)
    small = ~wide[row]
    out[row[small], (np.arange(len(x)) - offsets[:-1][row])[small]] = np.floor(scale * x[small]).astype(np.int64)
    return out, wide


def block_scores(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Scores of all queries against a block, one term after the other; zero weights and empty posting lists cost nothing."""
    scores = np.zeros((len(queries), len(block)), np.int64)
    for term in range(min(queries.shape[1], block.shape[1])):
        postings = block[:, term]
        if not postings.any():
            continue
        rows = np.flatnonzero(queries[:, term])
        if len(rows) == len(queries):
            scores += np.multiply.outer(queries[:, term], postings)
        elif len(rows):
            scores[rows] += np.multiply.outer(queries[rows, term], postings)
    return scores


def best(query: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries (query, score, id), the k best of each query: higher scores first, ties to the smaller id."""
    order = np.lexsort((ids, ~scores, query))
    query, scores, ids = query[order], scores[order], ids[order]
    heads = np.concatenate([[True], query[1:] != query[:-1]])[: len(query)]
    place = np.arange(len(query)) - np.maximum.accumulate(np.where(heads, np.arange(len(query)), 0))
    keep = place < k
    return query[keep], scores[keep], ids[keep]


def _wide_key(score: int) -> str:
    """Empty for a score of 64 bits; beyond, a text that sorts like the score among those of its sign."""
    if _LOW < score < _HIGH:
        return ""
    digits = f"{abs(score):x}"
    if score > 0:
        return f"{len(digits):08d}{digits}"
    return f"{10**8 - 1 - len(digits):08d}{''.join(f'{15 - int(d, 16):x}' for d in digits)}"


class _Cell:
    """The queries of one cell and the best candidates so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, offsets: np.ndarray, k: int, scale: int):
        self.ids, self.x, self.offsets, self.k, self.scale = ids, x, offsets, k, scale
        self.rows, self.wide = _dense(x, offsets, scale)
        self.tops = tuple(np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(len(ids), _LOW)  # the k-th best score so far, once there are k
        self.wide_tops: dict[int, list[tuple[int, int]]] = {}

    def _exact(self, q: int, vector: list[int], name: int) -> None:
        if name != self.ids[q]:
            own = [quantised(float(v), self.scale) for v in self.x[self.offsets[q] : self.offsets[q + 1]]]
            found = self.wide_tops.setdefault(q, [])
            found.append((-sum(a * b for a, b in zip(own, vector, strict=False)), name))
            if len(found) > 4 * self.k:
                self.wide_tops[q] = sorted(found)[: self.k]

    def meet(self, ids: np.ndarray, x: np.ndarray, offsets: np.ndarray) -> None:
        """Score a block of candidates."""
        block, wide = _dense(x, offsets, self.scale)
        # pairs with a wide vector on either side, in Python's integers
        for c in range(len(ids)) if self.wide.any() else np.flatnonzero(wide):
            vector = [quantised(float(v), self.scale) for v in x[offsets[c] : offsets[c + 1]]]
            for q in range(len(self.ids)) if wide[c] else np.flatnonzero(self.wide):
                self._exact(int(q), vector, int(ids[c]))
        block, ids = block[~wide], ids[~wide]
        small, found = np.flatnonzero(~self.wide), []
        for at in range(0, len(small), _QUERIES):
            q = small[at : at + _QUERIES]
            scores = block_scores(self.rows[q], block)
            own = ids[None, :] == self.ids[q][:, None]
            least = self.floor[q]
            if len(ids) > self.k:  # one more than k, as the query itself may be among them
                least = np.maximum(least, np.partition(scores, len(ids) - self.k - 1, axis=1)[:, len(ids) - self.k - 1])
            r, c = np.nonzero((scores >= least[:, None]) & ~own)
            found.append((q[r], scores[r, c], ids[c]))
        if found:
            self.tops = best(*[np.concatenate([t, *[f[i] for f in found]]) for i, t in enumerate(self.tops)], self.k)
            query, score, _ = self.tops
            last = np.flatnonzero(np.concatenate([query[1:] != query[:-1], [True]])[: len(query)])
            full = np.bincount(query, minlength=len(self.ids))[query[last]] == self.k
            self.floor[query[last[full]]] = score[last[full]]

    def result(self) -> pa.RecordBatch:
        query, score, name = self.tops
        keep = ~np.isin(query, list(self.wide_tops))
        rows = list(zip(self.ids[query[keep]].tolist(), name[keep].tolist(), score[keep].tolist(), [""] * int(keep.sum()), strict=True))
        for q, found in self.wide_tops.items():
            mine = query == q
            both = sorted([*found, *zip((-score[mine].astype(object)).tolist(), name[mine].tolist(), strict=True)])[: self.k]
            rows += [(int(self.ids[q]), i, min(max(-s, _LOW), _HIGH), _wide_key(-s)) for s, i in both]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["query_id", "id", "score", "wide"])


def exact_top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, modulus: int = 100, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, key, score): for each row whose key is divisible by ``modulus``, the k best other rows.

    Vectors that are null or hold null or non-finite components take no part, nor do rows with a null key; an empty
    vector scores 0 with everything; vectors of different lengths are compared over the shorter one. Rows with a query's
    own key are its own; a repeated query key asks once, with the least of its vectors. Components may be of any size:
    ranks follow the exact integers, and a score that 64 bits cannot hold is shown as the nearest one they can. Other
    columns are ignored. An empty table gives an empty result.
    """
    names = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    broken = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = names.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", broken))
    asked = rows.filter(F.col("id") % modulus == 0).groupBy("id").agg(F.min("v").alias("v"))
    count, width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    across = max(1, -(-count * (width or 0) * 8 // GROUP_BYTES))
    down = max(1, partitions(vectors.sparkSession) // across)
    group = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = asked.select(group(across, 1).alias("q"), every(down).alias("c"), F.lit(0).alias("side"), "id", "v")
    candidates = rows.select(every(across).alias("q"), group(down, 2).alias("c"), F.lit(1).alias("side"), "id", "v")
    met = queries.unionByName(candidates).select((F.col("q") * down + F.col("c")).alias("cell"), "side", "id", "v")
    met = met.repartitionById(across * down, "cell").sortWithinPartitions("side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cell = [], None
        for batch in batches:
            side = batch.column(1).to_numpy()
            asks = batch.slice(0, int(np.searchsorted(side, 1)))
            if asks.num_rows:
                held.append(asks)
            batch = batch.slice(asks.num_rows)
            if not batch.num_rows or not held:
                continue
            if cell is None:
                ids = np.concatenate([h.column(2).to_numpy() for h in held])
                cell = _Cell(ids, *_ragged(pa.concat_arrays([h.column(3) for h in held])), k, scale)
            for at in range(0, batch.num_rows, _CANDIDATES):
                part = batch.slice(at, _CANDIDATES)
                cell.meet(part.column(2).to_numpy(), *_ragged(part.column(3)))
        if cell is not None:
            yield cell.result()

    found = met.mapInArrow(search, "query_id long, id long, score long, wide string")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("wide").desc(), F.col("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")
