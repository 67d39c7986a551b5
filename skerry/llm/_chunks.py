"""Chunks of documents, and what travels between chunks and key buckets.

Several operators need, for everything that occurs in a document, something known only of the whole corpus: a word's
ids, an n-gram's count, a string's first document. A row per occurrence would shuffle many times the input. Instead each
chunk of rows sends every bucket one compressed blob of its distinct keys, the bucket answers each chunk with one blob,
and the chunk's texts come together with the answers. A chunk is a fixed range of rows of one file, so a task that runs
again, or another split of the files, gives the same chunks.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm._shared import written
from skerry.llm._text import flat

ROWS = 2048
#: Kind of the rows that hold texts: they come after the answers of their chunk.
TEXTS = 1 << 30
_FLUSH = 2 << 20


def squeeze(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed blob: their types and lengths, then their bytes."""
    head = np.array([x for a in arrays for x in (ord(a.dtype.kind), a.dtype.itemsize, len(a))], "<i8")
    body = b"".join([np.int64(len(arrays)).tobytes(), head.tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]])
    return zstandard.ZstdCompressor(level=level).compress(body)


def expand(blob: bytes) -> list[np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(body, "<i8", 1)[0])
    head = np.frombuffer(body, "<i8", 3 * n, 8)
    at, out = 8 + 24 * n, []
    for kind, size, length in head.reshape(-1, 3):
        out.append(np.frombuffer(body, f"<{chr(kind)}{size}", int(length), at))
        at += int(size * length)
    return out


def with_chunks(docs: DataFrame, key: str, text: str, rows: int = ROWS, carry: bool = False) -> DataFrame:
    """(chunk long, key long, text string), and with ``carry`` all other columns as other0, other1 and so on. Rows that do not come straight from files are written to the shared folder
    first, so that their place never changes."""
    try:
        docs.select("_metadata.row_index", "_metadata.file_path")
    except AnalysisException:
        docs = written(docs if carry else docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), "texts")
    # the file's hash above, the range's number below: consecutive ranges are dealt to consecutive partitions
    chunk = F.shiftleft(F.xxhash64(F.col("_metadata.file_path")), 24) + F.floor(F.col("_metadata.row_index") / rows) % (1 << 24)
    others = [F.col(f"`{c}`").alias(f"other{i}") for i, c in enumerate(c for c in docs.columns if c != text)] if carry else []
    return docs.select(chunk.alias("chunk"), F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"), *others)


def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batch in pieces of one chunk each."""
    chunk = batch.column(0).to_numpy(zero_copy_only=False)
    if len(chunk):
        edges = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(chunk)]
        for low, high in zip(edges, edges[1:], strict=False):
            yield int(chunk[low]), batch.slice(low, high - low)


def dealt(df: DataFrame, n: int, column: str, *then: str) -> DataFrame:
    """Rows of one number in ``column`` together, numbers dealt in turn over n partitions (a hash would give some several and
    others none), sorted by ``column`` and ``then``."""
    return df.repartitionById(n, F.pmod(F.col(column), F.lit(n)).cast("int")).sortWithinPartitions(column, *then)


def text_blobs(chunked: DataFrame) -> DataFrame:
    """(chunk, kind, blob) with all texts and keys of ``chunked``, some megabytes a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(chunk, parts):
            blob = squeeze(*[np.concatenate([p[i] for p in parts]) for i in range(len(parts[0]))], level=3)
            return pa.record_batch([pa.array([chunk], pa.int64()), pa.array([TEXTS], pa.int32()), pa.array([blob], pa.binary())], names=["chunk", "kind", "blob"])

        now, held, size = None, [], 0
        for batch in batches:
            for chunk, part in runs(batch):
                data, offsets = flat(part.column(2))
                valid = part.column(1).is_valid().to_numpy(zero_copy_only=False).astype("u1")
                keys = part.column(1).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
                for a, b in portions(offsets, _FLUSH):
                    if held and (chunk != now or size + offsets[b] - offsets[a] > _FLUSH):
                        yield out(now, held)
                        held, size = [], 0
                    now = chunk
                    row = [keys[a:b], valid[a:b], np.diff(offsets[a : b + 1]).astype("<i8"), data[offsets[a] : offsets[b]].copy()]
                    if part.num_columns > 3:
                        sink = pa.BufferOutputStream()
                        others = pa.record_batch(part.columns[3:], names=part.schema.names[3:]).slice(a, b - a)
                        with pa.ipc.new_stream(sink, others.schema) as stream:
                            stream.write_batch(others)
                        carried = np.frombuffer(sink.getvalue(), np.uint8)
                        row += [np.array([len(carried)], "<i8"), carried]
                    held.append(row)
                    size += int(offsets[b] - offsets[a])
        if held:
            yield out(now, held)
        held = []
        release()

    return chunked.mapInArrow(run, "chunk long, kind int, blob binary")


def portions(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes; a longer text is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, to
        at = to


def release() -> None:
    """Give freed memory back to the system, so that idle Python workers do not hold what their largest group needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a glibc system
        pass


def texts_of(blob: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Keys (nulls kept), bytes and n + 1 offsets of a text blob."""
    keys, valid, sizes, data = expand(blob)[:4]
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return pa.array(keys, mask=valid == 0), data, offsets


def others_of(blob: bytes) -> pa.RecordBatch:
    """The carried columns of a text blob's rows."""
    sizes, data = expand(blob)[4:6]
    edges = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    tables = [pa.ipc.open_stream(pa.py_buffer(data[a:b])).read_all() for a, b in zip(edges, edges[1:], strict=False)]
    return pa.concat_tables(tables).combine_chunks().to_batches()[0]


def grouped(batches: Iterator[pa.RecordBatch], columns: int = 1) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows in order, grouped by their first columns; a group must be read before the next is asked for."""
    from itertools import groupby

    def rows():
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    for head, group in groupby(rows(), key=lambda r: r[:columns]):
        yield head, group
        release()


def to_buckets(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted 64-bit keys, bucket edges: keys are dealt by range, so each bucket's keys stay together and sorted."""
    width = (1 << 64) // buckets + 1
    bounds = np.array([min(i * width, (1 << 64) - 1) for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds)]), np.concatenate([np.searchsorted(keys, bounds), [len(keys)]])
