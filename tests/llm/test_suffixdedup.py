import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.llm import suffixdedup


def brute(rows):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for p in range(len(t) - 49):
            w = t[p : p + 50]
            first[w] = min(first.get(w, 1 << 70), 1 << 69 if i is None else i)
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < (1 << 69 if i is None else i):
                gone[p : p + 50] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((i, len(t), int(gone.sum()), edges[::2].tolist(), edges[1::2].tolist(), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return sorted(out, key=str)


def test_deep_shallow_orders_suffixes():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 400).astype(np.uint8)
    text = np.concatenate([text, text[100:300], np.full(150, 97, np.uint8), text[50:250]])
    starts = np.arange(len(text) - 49)
    order, same = suffixdedup.deep_shallow(text, starts)
    strings = [text[s : s + 50].tobytes() for s in starts[order]]
    assert strings == sorted(strings) and sorted(order.tolist()) == starts.tolist()
    assert [bool(x) for x in same] == [False] + [a == b for a, b in zip(strings, strings[1:])]


@pytest.mark.parametrize("rows_a_chunk", [2, 4096])
def test_same_as_brute_force(spark, rows_a_chunk):
    rng = np.random.default_rng(4)

    def prose(n):
        return " ".join("".join(rng.choice(list("aeioué"), rng.integers(1, 5))) for _ in range(n))

    passages = [prose(n) for n in (9, 14, 15, 16, 40, 300)]
    rows = []
    for i in range(60):
        parts = [prose(int(rng.integers(0, 40))) for _ in range(3)]
        parts.insert(int(rng.integers(0, 3)), passages[int(rng.integers(0, 6))])
        rows.append((int(rng.integers(0, 1000)), " ".join(parts)))
    rows += [(2000, rows[0][1]), (2001, rows[0][1]), (2001, rows[0][1]), (None, rows[1][1]), (None, "own " + passages[4])]
    rows += [(3000, None), (3001, ""), (3002, "a" * 49), (3003, "a" * 49), (3004, "a" * 50), (3005, "a" * 3000), (3006, "a" * 51 + "b" + "a" * 80), (3007, "xy" * 200), (3008, "yx" * 200)]
    docs = spark.createDataFrame([(*r, b"x") for r in rows], "doc_id long, text string, kept binary")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.starts, r.ends, bytes(r.kept)) for r in suffixdedup.remove_repeats(docs, rows=rows_a_chunk).collect()), key=str)
    assert got == brute(rows)
    whole = suffixdedup.dedup_texts(docs.withColumn("n", F.lit(1.5)), rows=rows_a_chunk)
    assert whole.dtypes == docs.withColumn("n", F.lit(1.5)).dtypes
    texts = sorted(((r.doc_id, r.text, bytes(r.kept), r.n) for r in whole.collect()), key=str)
    assert texts == sorted(((i, k.decode("utf-8", "ignore"), b"x", 1.5) for i, *_, k in brute(rows)), key=str)


def test_empty_table(spark):
    assert suffixdedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tries_order_long_common_prefixes():
    """Suffixes that agree for 16 bytes and more, on strings that differ at each later place, in one group and in several."""
    rng = np.random.default_rng(8)
    for prefix in (16, 23, 31, 41, 47, 49):
        heads = [bytes(rng.integers(97, 100, prefix, dtype=np.uint8)) for _ in range(3)]
        rows = [heads[int(rng.integers(0, 3))] + bytes(rng.integers(0, 256, 50 - prefix, dtype=np.uint8) if rng.integers(0, 2) else rng.integers(97, 99, 50 - prefix, dtype=np.uint8)) for _ in range(400)]
        rows += rows[:50]
        text = np.frombuffer(b"".join(rows), np.uint8)
        order, same = suffixdedup.deep_shallow(text, np.arange(len(rows)) * 50)
        strings = [rows[i] for i in order]
        assert strings == sorted(rows) and sorted(order.tolist()) == list(range(len(rows)))
        assert same.tolist() == [False] + [a == b for a, b in zip(strings, strings[1:])]
    order, same = suffixdedup.deep_shallow(np.zeros(60, np.uint8), np.zeros(0, np.int64))
    assert len(order) == len(same) == 0


def test_equal_hashes_are_not_equal_bytes(spark, monkeypatch):
    """With every stretch under one hash and every anchor under one key, results stay those of the bytes."""
    whole = suffixdedup.Stretches.__init__

    def weak(self, data, offsets):
        whole(self, data, offsets)
        self.text = np.zeros_like(self.text)
        self.anchor = self.anchor & np.uint64(1 << 63)

    rng = np.random.default_rng(9)
    passage = bytes(rng.integers(97, 123, 90, dtype=np.uint8)).decode()
    rows = [(i, bytes(rng.integers(97, 123, 70, dtype=np.uint8)).decode() + passage * (i % 3 > 0) + "z" * i) for i in range(40)]
    monkeypatch.setattr(suffixdedup.Stretches, "__init__", weak)
    from skerry.llm._chunks import squeeze

    texts = [t.encode() for _, t in rows]
    blob = squeeze(np.arange(40), np.ones(40, np.uint8), np.array([len(t) for t in texts]), np.frombuffer(b"".join(texts), np.uint8))
    flags = [squeeze(np.packbits(np.ones(2, bool)), np.array([2], "<i8"))]
    chunk = suffixdedup._Chunk(flags, [blob])
    data = b"".join(texts)
    stretch = lambda i: data[chunk.low[i] : chunk.low[i] + chunk.length[i]]
    assert all(stretch(i) == stretch(chunk.heads[chunk.of[i]]) for i in range(len(chunk.low))) and len(chunk.heads) < len(chunk.low)


def test_one_gram_everywhere(spark):
    """A 20-byte gram that all texts have, each with other bytes around it: a hot anchor without copies, and some with."""
    rng = np.random.default_rng(10)
    word = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    rows = [(i, word(60) + "0" * 20 + word(60)) for i in range(300)] + [(400 + i, "x" * 40 + "0" * 20 + "y" * 40) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.starts, r.ends, bytes(r.kept)) for r in suffixdedup.remove_repeats(docs, rows=64).collect()), key=str)
    assert got == brute(rows)


def test_carried_columns_come_back_equal(spark):
    long = "a passage of more than fifty bytes that two of the documents have in common"
    sql = f"""SELECT * FROM VALUES
      (1, '{long} one', TIMESTAMP '2024-01-01 00:00:00.123456', TIMESTAMP_NTZ '2024-01-01 00:00:00.123456', map(1, 'a', 2, null), INTERVAL '1 02:03:04.5' DAY TO SECOND, array(1.5BD, null), named_struct('x', X'00ff', 'y', DATE '0001-01-01'), double('nan')),
      (2, 'two {long}', null, null, null, null, null, null, null),
      (3, null, TIMESTAMP '1900-01-01 00:00:00.000001', TIMESTAMP_NTZ '1500-01-01 00:00:00.000001', map(), INTERVAL '-1 02:03:04.000001' DAY TO SECOND, array(), named_struct('x', X'', 'y', null), -0.0D)
      AS t(doc_id, text, kept, chunk, m, i, a, s, f)"""
    docs = spark.sql(sql)
    whole = suffixdedup.dedup_texts(docs)
    assert whole.dtypes == docs.dtypes
    plain = lambda df: sorted(map(str, df.drop("text").collect()))
    assert plain(whole) == plain(docs)
    assert {r.doc_id: r.text for r in whole.select("doc_id", "text").collect()} == {1: f"{long} one", 2: "two " , 3: ""}
    assert suffixdedup.dedup_texts(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    rng = np.random.default_rng(11)
    base = bytes(rng.integers(97, 123, 2_000_000, dtype=np.uint8)).decode()
    docs = spark.createDataFrame([(1, base), (2, base[500_000:] + "é" + base[:100])], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.starts, r.ends) for r in suffixdedup.remove_repeats(docs).collect()}
    assert got == {1: (2_000_000, 0, [], []), 2: (1_500_102, 1_500_100, [0, 1_500_002], [1_500_000, 1_500_102])}
