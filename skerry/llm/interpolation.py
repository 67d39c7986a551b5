"""LM scoring by deleted interpolation.

P(w | v) mixes three estimates: uniform over the vocabulary and one unknown word, unigram and bigram maximum likelihood.
The mixture weights depend on how often the context v was seen, by powers of two, and are learned by expectation
maximisation on a part of the training documents whose counts are deleted from the estimates meanwhile (fold 1 of
crc32 mod 10; fold 0 is never learned from). Scores then use the counts of all training documents.

Counts cover every document. Each chunk of documents sends every bucket its distinct words and pairs with their counts, a
bucket adds them up over the corpus and answers each chunk with the totals in the chunk's own order. So what is gathered grows
with the distinct n-grams per chunk, never with pairs of documents, and a frequent word is one entry per chunk. Buckets find
words by a 64-bit hash and hold their bytes against each other; pairs have a key of 96 bits. Where two different ones meet
under one hash, all is done again with another hash function, so counts are exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm._chunks import ROWS, TEXTS, dealt, expand, grouped, release, runs, squeeze, text_blobs, texts_of, to_buckets, with_chunks
from skerry.llm._shared import forget, partitions, written
from skerry.llm._text import LOWER, SEPARATOR, flat, word_bounds, xxh64

FOLDS = 10
#: Context-frequency buckets: the number of binary digits of a count of 64 bits, and 0 for unseen.
BUCKETS = 65
#: The end and the start of a text among the words: no word has white space.
_END, _START = b"\n", b"\t"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _words_from(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])


@dataclass(frozen=True)
class Hash:
    """How words are hashed: 64 bits of XXH64 under a seed, or fewer."""

    seed: int = 0
    bits: int = 64

    def of(self, words: pa.Array) -> np.ndarray:
        data, offsets = flat(words)
        return xxh64(data, offsets[:-1], offsets[1:], self.seed) << np.uint64(64 - self.bits)


class Tokens:
    """The tokens of some documents: distinct words with their bytes and distinct pairs, both in the order of their keys, and
    each token's word, pair and context among them."""

    def __init__(self, keys: list, data: np.ndarray, offsets: np.ndarray, by: Hash):
        starts, ends, before = word_bounds(data, offsets)
        coded = _words_from(ends - starts, LOWER[data[~SEPARATOR[data]]]).dictionary_encode()
        words = pa.concat_arrays([coded.dictionary, pa.array([_END, _START], pa.large_binary())])
        n, v = len(offsets) - 1, len(words)
        self.counts = np.diff(before) + 1
        self.first = before[:-1] + np.arange(n)
        token = np.full(len(starts) + n, v - 2, np.int64)
        inside = np.ones(len(token), bool)
        inside[before[1:] + np.arange(n)] = False
        token[inside] = coded.indices.to_numpy()
        previous = np.empty_like(token)
        previous[1:] = token[:-1]
        previous[self.first] = v - 1
        hashes = by.of(words)
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(v, np.int64)
        rank[order] = np.arange(v)
        self.words, self.word_keys, self.start = words.take(pa.array(order)), hashes[order], int(rank[v - 1])
        self.word_of, self.context_of = rank[token], rank[previous]
        pairs, of = np.unique(previous * v + token, return_inverse=True)
        left, right = hashes[pairs // v], hashes[pairs % v]
        with np.errstate(over="ignore"):
            key = _mix(left * np.uint64(0xD6E8FEB86659FD93) + _mix(right))
            check = (_mix(right * np.uint64(0x9E3779B97F4A7C15) ^ left) >> np.uint64(32)).astype("<u4")
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(pairs), np.int64)
        rank[order] = np.arange(len(pairs))
        self.pair_keys, self.pair_checks, self.pair_of = key[order], check[order], rank[of]
        self.fold = np.array([zlib.crc32(("" if k is None else str(k)).encode()) % FOLDS for k in keys], np.int64)
        self.token_fold = np.repeat(self.fold, self.counts)

    def distinct(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Counts of words and of pairs in the documents estimated from (folds 2 up) and in the deleted part (fold 1)."""
        out = []
        for part, documents in ((self.token_fold > 1, self.fold > 1), (self.token_fold == 1, self.fold == 1)):
            words = np.bincount(self.word_of[part], minlength=len(self.word_keys)).astype(np.int64)
            words[self.start] = documents.sum()
            out.append((words, np.bincount(self.pair_of[part], minlength=len(self.pair_keys)).astype(np.int64)))
        return out

    def counts_of(self, words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token, the counts of its word, its pair and its context."""
        return words[self.word_of], pairs[self.pair_of], words[self.context_of]


def _packed_keys(keys: np.ndarray) -> np.ndarray:
    """Differences of sorted keys by byte plane: the upper planes are nearly all zero and compress away."""
    step = np.diff(keys, prepend=np.uint64(0))
    return np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).reshape(-1)


def _unpacked_keys(planes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).reshape(-1), dtype=np.uint64)


def _planes(count: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(count.astype("<i8").view(np.uint8).reshape(-1, 8).T).reshape(-1)


def _unplanes(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").reshape(-1)


def _read_chunk(parts: list[tuple[pa.Array, np.ndarray, np.ndarray]], by: Hash) -> tuple[pa.Array, Tokens]:
    keys = pa.concat_arrays([p[0] for p in parts])
    offsets = [p[2] for p in parts]
    base = np.concatenate([[0], np.cumsum([o[-1] for o in offsets])])
    joined = np.concatenate([offsets[0][:1], *[o[1:] + b for o, b in zip(offsets, base, strict=False)]])
    return keys, Tokens(keys.to_pylist(), np.concatenate([p[1] for p in parts]), joined, by)


def _grams(chunked: DataFrame, buckets: int, by: Hash) -> DataFrame:
    """(bucket, chunk, blob): the chunk's distinct words and pairs with their counts. A chunk that two tasks share sends twice; sums
    do not mind, and answers go by chunk and are merged there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(chunk, held):
            t = _read_chunk(held, by)[1]
            (est, est2), (hold, hold2) = t.distinct()
            data, at = flat(t.words)
            for b, (a, z, a2, z2) in enumerate(zip(*to_buckets(t.word_keys, buckets), *to_buckets(t.pair_keys, buckets), strict=True)):
                if z > a or z2 > a2:
                    words = [_packed_keys(t.word_keys[a:z]), np.diff(at[a : z + 1]).astype("<u4"), data[at[a] : at[z]], _planes(est[a:z]), _planes(hold[a:z])]
                    pairs = [_packed_keys(t.pair_keys[a2:z2]), t.pair_checks[a2:z2], _planes(est2[a2:z2]), _planes(hold2[a2:z2])]
                    yield pa.record_batch([pa.array([b], pa.int32()), pa.array([chunk], pa.int64()), pa.array([squeeze(*words, *pairs)], pa.binary())], names=["bucket", "chunk", "blob"])

        now, held = None, []
        for batch in batches:
            for chunk, part in runs(batch):
                if held and chunk != now:
                    yield from out(now, held)
                    held = []
                    release()
                now = chunk
                data, offsets = flat(part.column(2))
                held.append((part.column(1), data, offsets))
        if held:
            yield from out(now, held)
        held = []
        release()

    return chunked.mapInArrow(run, "bucket int, chunk long, blob binary")


class _Sums:
    """Distinct keys of one bucket with their totals, from all chunks' keys, what tells their owners apart, and counts."""

    def __init__(self, keys: list[np.ndarray], owners: np.ndarray, est: list[np.ndarray], hold: list[np.ndarray]):
        self.keys, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        self.clashes = int((owners != owners[first][place]).sum())
        self.est, self.hold = (np.zeros(len(self.keys), np.int64) for _ in range(2))
        np.add.at(self.est, place, np.concatenate(est))
        np.add.at(self.hold, place, np.concatenate(hold))

    def answer(self, keys: list[np.ndarray]) -> list[np.ndarray]:
        own = np.searchsorted(self.keys, keys[0] if len(keys) == 1 else np.unique(np.concatenate(keys)))
        return [_planes(self.est[own]), _planes(self.hold[own])]


def _totals(grams: DataFrame, by: Hash) -> DataFrame:
    """(chunk, kind, blob, n_est, n_hold, v_est, v_all, clashes): answers, and one row of sums per bucket with a null chunk."""
    names = ("n_est", "n_hold", "v_est", "v_all", "clashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary()), *[(c, pa.int64()) for c in names]])
        start = by.of(pa.array([_START], pa.large_binary()))[0]
        for (bucket,), rows in grouped(batches):
            by_chunk: dict[int, list[tuple]] = {}
            parts = []
            for _, chunk, blob in rows:
                words, lengths, data, est, hold, pairs, checks, est2, hold2 = expand(blob)
                words, pairs = _unpacked_keys(words), _unpacked_keys(pairs)
                by_chunk.setdefault(chunk, []).append((words, pairs))
                parts.append((words, _words_from(lengths, data), _unplanes(est), _unplanes(hold), pairs, checks, _unplanes(est2), _unplanes(hold2)))
            columns = list(zip(*parts, strict=True))
            spelled = pa.chunked_array(columns[1], pa.large_binary()).combine_chunks().dictionary_encode().indices.to_numpy()
            w, p = _Sums(columns[0], spelled, columns[2], columns[3]), _Sums(columns[4], np.concatenate(columns[5]), columns[6], columns[7])
            real = w.keys != start
            sums = [w.est[real].sum(), w.hold[real].sum(), (w.est[real] > 0).sum(), ((w.est + w.hold)[real] > 0).sum(), w.clashes + p.clashes]
            yield pa.record_batch([pa.array([None], pa.int64()), pa.array([bucket], pa.int32()), pa.array([None], pa.binary()), *[pa.array([int(x)], pa.int64()) for x in sums]], schema=schema)
            for chunk, own in by_chunk.items():
                blob = squeeze(*w.answer([o[0] for o in own]), *p.answer([o[1] for o in own]))
                yield pa.record_batch([pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), pa.array([blob], pa.binary()), *[pa.array([None], pa.int64())] * len(names)], schema=schema)

    return grams.mapInArrow(run, "chunk long, kind int, blob binary, " + ", ".join(f"{c} long" for c in names))


def _chunks_with_counts(batches: Iterator[pa.RecordBatch], by: Hash) -> Iterator[tuple[pa.Array, Tokens, tuple, tuple]]:
    """Per chunk: document keys, tokens, and the answered counts of words and pairs, estimated and deleted."""
    for _, rows in grouped(batches):
        answers, parts = [], []
        for _, kind, blob in rows:
            if kind == TEXTS:
                parts.append(texts_of(blob))
            else:
                answers.append([_unplanes(x) for x in expand(blob)])
        if parts and answers:
            keys, tokens = _read_chunk(parts, by)
            est, hold, est2, hold2 = (np.concatenate([a[i] for a in answers]) for i in range(4))
            if len(est) != len(tokens.word_keys) or len(est2) != len(tokens.pair_keys):
                raise RuntimeError("a chunk changed between two passes")
            yield keys, tokens, (est, est2), (hold, hold2)


def _context_bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 0)


def _estimates(word: np.ndarray, pair: np.ndarray, context: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context bucket, unigram and bigram maximum likelihood."""
    return _context_bucket(context), word / max(n, 1), np.where(context > 0, pair / np.maximum(context, 1), 0.0)


def learn_weights(items: DataFrame, uniform: float, rounds: int = 25, close: float = 1e-4) -> np.ndarray:
    """Weights (bucket, 3) by expectation maximisation over blobs of (bucket, unigram, bigram, times)."""
    weights = np.tile([0.1, 0.4, 0.5], (BUCKETS, 1))
    weights[0] = [0.2, 0.8, 0.0]

    def expect(now: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((BUCKETS, 3))
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    bucket, uni, bi, times = expand(blob)
                    share = now[bucket] * np.stack([np.full(len(uni), uniform), uni, bi], axis=1)
                    share *= (times / share.sum(axis=1))[:, None]
                    for k in range(3):
                        sums[:, k] += np.bincount(bucket, share[:, k], BUCKETS)
            yield pa.record_batch([pa.array(np.arange(BUCKETS), pa.int32()), *[pa.array(sums[:, k]) for k in range(3)]], names=["b", "s0", "s1", "s2"])

        return run

    for _ in range(rounds):
        sums = np.zeros((BUCKETS, 3))
        summed = items.mapInArrow(expect(weights), "b int, s0 double, s1 double, s2 double").groupBy("b").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(3)])
        for r in summed.collect():  # BUCKETS rows at most
            sums[r.b] = [r.s0, r.s1, r.s2]
        new = (sums + 0.01 * weights) / (sums.sum(axis=1, keepdims=True) + 0.01)
        moved = np.abs(new - weights).max()
        weights = new
        if moved < close:
            break
    return weights


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = ROWS, by: Hash = Hash()) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    A null text is an empty one: it has one token, the end. A null key counts as the empty text in the choice of folds
    (fold 0). Repeated rows are counted and scored as often as they come; other columns are ignored. With no training
    document every count is 0: the base is that of an empty model and the score that of the uniform estimate. An empty table
    gives an empty result.
    """
    n = partitions(docs.sparkSession)
    fold = F.crc32(F.coalesce(F.col("key").cast("string"), F.lit(""))) % FOLDS
    # The deleted part has chunks of its own, so that learning the weights reads only its texts.
    others = with_chunks(docs, key, text, rows).filter(fold != 1)
    part = with_chunks(docs, key, text, rows * 8).filter(fold == 1).withColumn("chunk", F.xxhash64("chunk", F.lit(1)))
    grams = dealt(_grams(others, n, by).unionByName(_grams(part, n, by)), n, "bucket", "chunk")
    table = written(_totals(grams, by), "ngram-totals")
    n_est, n_hold, v_est, v_all, clashes = (int(x or 0) for x in table.agg(*[F.sum(c) for c in ("n_est", "n_hold", "v_est", "v_all", "clashes")]).first())
    if clashes:
        forget(table)
        return score(docs, key, text, rows, Hash(by.seed + 1))
    answers = table.filter("chunk IS NOT NULL").select("chunk", "kind", "blob")

    def deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, est, _ in _chunks_with_counts(batches, by):
            word, pair, context = tokens.counts_of(*est)
            bucket, uni, bi = _estimates(word, pair, context, n_est)
            both = (uni.astype("<f4").view("<u4").astype(np.uint64) << np.uint64(32)) | bi.astype("<f4").view("<u4")
            for b in np.unique(bucket):
                seen, times = np.unique(both[bucket == b], return_counts=True)
                columns = [np.full(len(seen), b, "u1"), (seen >> np.uint64(32)).astype("<u4").view("<f4"), (seen & np.uint64(0xFFFFFFFF)).astype("<u4").view("<f4"), times.astype("<i4")]
                yield pa.record_batch([pa.array([squeeze(*columns)], pa.binary())], names=["blob"])

    learned = part.select("chunk").distinct()
    met = dealt(answers.join(learned, "chunk", "left_semi").unionByName(text_blobs(part)), n, "chunk", "kind")
    items = written(met.mapInArrow(deleted, "blob binary"), "deleted-items")
    weights = learn_weights(items, 1.0 / (v_est + 1))
    total = n_est + n_hold

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, tokens, est, hold in _chunks_with_counts(batches, by):
            word, pair, context = tokens.counts_of(*[a + b for a, b in zip(est, hold, strict=True)])
            bucket, uni, bi = _estimates(word, pair, context, total)
            w = weights[bucket]
            w = np.where((context > 0)[:, None], w, w * [1.0, 1.0, 0.0])
            mixed = (w * np.stack([np.full(len(uni), 1.0 / (v_all + 1)), uni, bi], axis=1)).sum(axis=1) / w.sum(axis=1)
            base = np.log10((word + 0.1) / (total + 0.1 * (v_all + 1)))
            by_text = lambda x: np.add.reduceat(x, tokens.first)
            columns = [tokens.fold == 0, tokens.counts, by_text((word > 0).astype(np.int64)), np.full(len(names), total), by_text(base), by_text(np.log10(mixed))]
            yield pa.record_batch([names, *[pa.array(c) for c in columns]], names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    met = dealt(answers.unionByName(text_blobs(others)).unionByName(text_blobs(part)), n, "chunk", "kind")
    return met.mapInArrow(judge, f"`{key}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
