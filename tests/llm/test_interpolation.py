import math
import re
import zlib
from collections import Counter

import pytest

from skerry.llm import interpolation

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    raw = (text or "").encode()
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    return [*WORD.findall(lower), None]


def fold(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 10


def brute(rows, rounds=25):
    train = [tokens(t) for i, t in rows if fold(i) > 0]
    est = [tokens(t) for i, t in rows if fold(i) > 1]
    hold = [tokens(t) for i, t in rows if fold(i) == 1]

    def counts(docs):
        return Counter(w for d in docs for w in d), Counter(p for d in docs for p in zip(["start", *d], d)), Counter(v for d in docs for v in ["start", *d[:-1]])

    def parts(model, pair):
        uni, bi, context = model
        c = context[pair[0]]
        return (c.bit_length(), 1 / (len(uni) + 1), uni[pair[1]] / max(1, sum(uni.values())), bi[pair] / c if c else 0.0)

    weights = {b: [0.1, 0.4, 0.5] for b in range(65)} | {0: [0.2, 0.8, 0.0]}
    model = counts(est)
    for _ in range(rounds):
        sums = {b: [0.0] * 3 for b in range(65)}
        for d in hold:
            for pair in zip(["start", *d], d):
                b, *p = parts(model, pair)
                share = [w * x for w, x in zip(weights[b], p)]
                for k in range(3):
                    sums[b][k] += share[k] / sum(share)
        new = {b: [(s + 0.01 * w) / (sum(sums[b]) + 0.01) for s, w in zip(sums[b], weights[b])] for b in sums}
        moved = max(abs(x - y) for b in new for x, y in zip(new[b], weights[b]))
        weights = new
        if moved < 1e-4:
            break
    model = counts(train)
    total, v = sum(model[0].values()), len(model[0])
    out = []
    for i, t in rows:
        d = tokens(t)
        base = sum(math.log10((model[0][w] + 0.1) / (total + 0.1 * (v + 1))) for w in d)
        logs = 0.0
        for pair in zip(["start", *d], d):
            b, *p = parts(model, pair)
            w = weights[b] if b else [*weights[b][:2], 0.0]
            logs += math.log10(sum(x * y for x, y in zip(w, p)) / sum(w))
        out.append((i, fold(i) == 0, len(d), sum(model[0][w] > 0 for w in d), total, base, logs))
    return out


def test_scores_equal_brute_force(spark):
    vocabulary = ["The", "the", "of", "cat", "café", "É", "x1", "dog", "ran", "on"]
    rows = [(i, " ".join(vocabulary[(i * 7 + k * k) % 10] for k in range(i % 23)) + ("\tEnd\n" if i % 3 else "")) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "word " * 3000), (5, "the cat"), (5, "the cat"), (None, "of the dog")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    got = sorted(map(tuple, interpolation.score(docs, rows=16).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[5])), sorted(want, key=lambda r: (str(r[0]), r[5]))):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-4)


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    row = interpolation.score(docs).first()
    assert row.held_out and row.n_tokens == 3 and row.n_known == 0 and row.train_tokens == 0 and row.base_score == pytest.approx(0.0)
    assert interpolation.score(docs.limit(0)).count() == 0


def test_clashing_hashes_are_found_and_done_again(spark):
    """With hashes of a few bits words meet under one key; counts stay those of the words."""
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 90}" for k in range(i % 23))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r) for r in interpolation.score(docs, rows=16, by=interpolation.Hash(0, 5)).collect()}
    for w in brute(rows):
        g = got[w[0]]
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-4)


def test_words_that_polynomial_hashes_confuse(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(i, one if i % 2 else f"{other} {other}") for i in range(40)]
    got = {r.doc_id: tuple(r) for r in interpolation.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for w in brute(rows):
        assert got[w[0]][:5] == w[:5] and got[w[0]][5] == pytest.approx(w[5], rel=1e-9)
