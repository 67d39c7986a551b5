import numpy as np
import pyarrow as pa
import xxhash

from skerry.llm import simhash


def brute_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    n = len(words)
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, n - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    name = {i: i for i, _ in rows}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for x, (i, a) in enumerate(rows):
        for j, b in rows[x + 1 :]:
            if bin(a ^ b).count("1") <= 3:
                p, q = root(i), root(j)
                name[max(p, q)] = min(p, q)
    return {i: root(i) for i, _ in rows}


TEXTS = ["", None, "one", "One two", "a b c d", "x " * 70, "Éa éB c\td\ne  f", "w" * 700 + " b c", "the same text of a few words here", "the same text of a few words here"]


def test_fingerprints_match_the_definition():
    got = simhash.fingerprints(pa.array(TEXTS, pa.string()))
    assert [int(x) for x in got] == [brute_print(t or "") for t in TEXTS]
    assert len(simhash.fingerprints(pa.array([], pa.string()))) == 0


def test_near_pairs_are_all_pairs_within_the_radius():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = np.array([int(base[i % 6]) ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 5)))) for i in range(300)], np.uint64)
    for radius in range(4):
        want = {(i, j) for i in range(300) for j in range(i + 1, 300) if bin(int(fps[i]) ^ int(fps[j])).count("1") <= radius}
        got = {(int(i), int(j)) for a, b in simhash.near_pairs(fps, np.full(300, 300), radius) for i, j in zip(a, b, strict=True)}
        assert got == want


def test_components_and_tiles(spark):
    rng = np.random.default_rng(2)
    fps = set()
    for c in rng.integers(-(1 << 62), 1 << 62, 12):
        x = int(c)
        for _ in range(20):
            x ^= sum(1 << int(b) for b in set(rng.integers(0, 62, 3)))
            fps.add(x)
    rows = sorted(fps)
    df = spark.createDataFrame([(x,) for x in rows], "fp long")
    want = brute_components([(x, x & (1 << 64) - 1) for x in rows])
    for tile in (16_384, 3):
        got = {r.node: r.root for r in simhash.components(simhash.near_links(df, tile=tile)).collect()}
        assert {x: got.get(x, x) for x in rows} == want


def test_near_duplicates_edge_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, "One two", "y"), (None, "one", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.component for r in got if r.doc_id is not None}
    assert by[0] == by[1] == 0 and by[9] == by[8] == 8
    assert simhash.keep_one(docs).columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    n = 3000
    order = np.random.default_rng(3).permutation(n).tolist()
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(n + 5, n + 9), (n + 9, n + 5)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert got == {i: 0 for i in range(1, n)} | {n + 9: n + 5}


def test_very_long_text_has_the_defined_print():
    text = " ".join(f"w{i * i % 7919}" for i in range(400_000))
    assert int(simhash.fingerprints(pa.array([text]))[0]) == brute_print(text)
