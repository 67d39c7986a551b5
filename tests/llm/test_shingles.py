import random

import numpy as np
import test_pipeline
import test_simhash
import xxhash

from skerry.llm import shingles, simhash


def brute_set(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(texts):
    sets, name = {i: brute_set(t) for i, t in texts.items()}, {i: i for i in texts}
    while True:
        before = dict(name)
        for i, a in sets.items():
            for j, b in sets.items():
                if a == b or 5 * len(a & b) >= 4 * len(a | b):
                    name[i] = name[j] = min(name[i], name[j])
        if name == before:
            return sorted(set(name.values()))


def edited(words, edits, seed):
    words, rng = list(words), random.Random(seed)
    for i in rng.sample(range(len(words)), edits):
        words[i] = f"edit{seed}x{i}"
    return " ".join(words)


def planted():
    """Bases with copies of which some keep 0.8 to 0.95 of the shingles and some less, texts of one common passage, and odd rows."""
    rng = random.Random(5)
    texts, passage = {}, " ".join(f"common{i}" for i in range(60))
    for g in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(120, 300))]
        for c, edits in enumerate((0, 1, 2, 3, 4, 5, 6, 8, 12)):
            texts[100 * g + c] = edited(base, edits, 100 * g + c)
    texts |= {5000 + i: passage + " " + " ".join(f"own{i}x{j}" for j in range(i % 30)) for i in range(90)}
    return texts | {9000 + i: t for i, t in enumerate(test_simhash.TEXTS)}


def test_keep_one_equals_brute_force(spark, monkeypatch):
    texts = planted()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_kept(texts)
    for slots in (1 << 18, 16):
        monkeypatch.setattr(shingles, "SLOTS", slots)
        assert sorted(r.doc_id for r in shingles.keep_one(docs).collect()) == want
    assert shingles.keep_one(docs.limit(0)).count() == 0


def test_stage_takes_five_words_and_four_fifths(spark):
    texts = planted()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    stage = dict(test_pipeline.corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == brute_kept(texts)


def test_tiles_lose_no_pair(spark):
    texts = planted()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = shingles.near_duplicates(docs, tile=4).filter("doc_id = component").collect()
    assert sorted(r.doc_id for r in got) == brute_kept(texts)


def test_wide_pairs_are_all_pairs_within_the_limit():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (5, 4), dtype=np.uint64)
    bits = base[rng.integers(0, 5, 200)]
    for i in range(200):
        for p in set(rng.integers(0, 256, rng.integers(0, 60)).tolist()):
            bits[i, p // 64] ^= np.uint64(1 << p % 64)
    limit = np.sort(rng.integers(0, 60, 200))
    until = np.minimum(np.arange(200) + rng.integers(1, 150, 200), 200)
    got = {(int(i), int(j)) for a, b in simhash.wide_pairs(bits, until, limit) for i, j in zip(a, b, strict=True)}
    differ = lambda i, j: int(np.bitwise_count(bits[i] ^ bits[j]).sum())
    want = {(i, j) for i in range(200) for j in range(i + 1, int(until[i])) if differ(i, j) <= limit[j]}
    assert want <= got and all(i < j < until[i] and differ(i, j) <= limit[-1] for i, j in got) and want


def test_folded_sketches_bound_the_difference():
    rng = np.random.default_rng(7)
    one, two = (np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64)) for _ in range(2))
    two = np.unique(np.concatenate([one[:800], two[:100]]))
    h, at = np.concatenate([one, two]), np.array([0, len(one), len(one) + len(two)])
    small, large = (np.frombuffer(x, "<u8") for x in shingles._parities(h, at, np.array([1024, 4096])))
    assert np.array_equal(shingles.folded(np.frombuffer(shingles._parities(h, at, np.array([4096, 4096]))[0], "<u8"), 16), small)
    differ = int(np.bitwise_count(small ^ shingles.folded(large, 16)).sum())
    assert 0 < differ <= len(np.setxor1d(one, two))


def test_odd_rows(spark):
    rows = [(1, "", "x"), (2, None, "y"), (3, "one two", "z"), (3, "one two", "z"), (None, "One  TWO", "w"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    got = sorted(map(tuple, shingles.near_duplicates(docs).collect()), key=str)
    assert got == [(1, 1), (2, 1), (3, 3), (3, 3), (None, 1), (None, 3)]
    kept = shingles.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 3]


def simhash_of(grams):
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_alone_joins_what_its_radius_reaches(spark, monkeypatch):
    rng, texts = random.Random(9), {}
    for g in range(40):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(120, 300))]
        texts |= {10 * g: " ".join(base), 10 * g + 1: edited(base, g % 8, g)}
    keyed = shingles._keyed
    monkeypatch.setattr(shingles, "_keyed", lambda *a: keyed(*a).filter("false"))  # the exact way for the rest finds nothing
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component for r in shingles.near_duplicates(docs).collect()}
    want = {}
    for g in range(0, 400, 10):
        a, b = brute_set(texts[g]), brute_set(texts[g + 1])
        near = (simhash_of(a) ^ simhash_of(b)).bit_count() <= 7 and 5 * len(a & b) >= 4 * len(a | b)
        want |= {g: g, g + 1: g if near else g + 1}
    assert got == want and 10 <= sum(i != c for i, c in want.items()) - sum(texts[g] == texts[g + 1] for g in range(0, 400, 10)) < 40


def test_simhash_pairs_are_the_closest_within_the_radius(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(8)]
    rows = [(i, rng.choice([60, 90, 100, 110]), centres[i % 8] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6)))) for i in range(160)]
    nodes = spark.createDataFrame([(i, n, x - (1 << 64) if x >> 63 else x) for i, n, x in rows], "sid long, n long, fp long")
    apart = {(i, j): (x ^ y).bit_count() for i, n, x in rows for j, m, y in rows if i > j and 5 * min(n, m) >= 4 * max(n, m)}
    best = {i: min([d for p, d in apart.items() if i in p and d <= 7], default=None) for i in range(160)}
    for tile in (shingles.TILE, 4):
        got = {(r.a, r.b) for r in shingles._simhash_pairs(nodes, tile).collect()}
        assert all(apart[p] <= 7 for p in got)
        assert {i: min([apart[p] for p in got if i in p], default=None) for i in range(160)} == best
