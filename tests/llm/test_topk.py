import math

from skerry.llm import topk


def brute(rows, k=10, modulus=100):
    usable = {i: [math.floor(1024 * x) for x in v] for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, a in usable.items():
        if q % modulus == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable.items() if i != q)
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


def test_ties_nulls_lengths(spark):
    rows = [(i, [float((i * 7 + d) % 5 - 2) / 8 for d in range(6)], i) for i in range(120)]
    rows += [(200, None, 1), (201, [1.0, None], 1), (202, [float("nan")] * 6, 1), (300, [], 1), (203, [0.5], 1), (None, [1.0], 1), (400, [0.0] * 6, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {tuple(r) for r in topk.exact_top_k(df).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute(rows)
    few = df.filter("vec_id in (0, 1, 2)")
    assert {tuple(r) for r in topk.exact_top_k(few).collect()} == brute([r for r in rows if r[0] in (0, 1, 2)])
    assert topk.exact_top_k(df.limit(0)).count() == 0


def test_components_of_any_size(spark):
    """Scores that 64 bits cannot hold: ranks follow the exact integers."""
    rows = [(0, [1.0, 2.0]), (1, [200_000.0, 1.0]), (2, [2.0, 0.0]), (3, [1e30, 0.0]), (4, [-1e30, 5.0]), (5, [1e30, 1.0]), (6, [1e305, -1e305]), (7, [3e9, 3e9]), (8, [-2e30, 0.0]), (100, [1e30, -1.0]), (200, [1e300, 1.0]), (9, [1e308, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    exact = {i: [topk.quantised(x) for x in v] for i, v in rows}
    for k in (3, 10):
        want = set()
        for q in (0, 100, 200):
            scored = sorted((-sum(a * b for a, b in zip(exact[q], v)), i) for i, v in exact.items() if i != q)[:k]
            want |= {(q, n + 1, i, clip(-s)) for n, (s, i) in enumerate(scored)}
        assert {tuple(r) for r in topk.exact_top_k(df, k=k).collect()} == want
    assert topk.quantised(1e30) == 1024 * int(1e30) and topk.quantised(-0.3) == -308


def test_repeated_queries_and_many_groups(spark, monkeypatch):
    rows = [(i % 250, [float((i * 13 + d * d) % 7 - 3) / 4 for d in range(5)], "x") for i in range(260)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, side string")
    least = {}
    for i, v, _ in rows:
        least[i] = min(least.get(i, v), v)
    want = set()
    for q in (0, 100, 200):
        a = [math.floor(1024 * x) for x in least[q]]
        scored = sorted((-sum(x * math.floor(1024 * y) for x, y in zip(a, v)), i) for i, v, _ in rows if i != q)[:10]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    for size in (32 << 20, 1):
        monkeypatch.setattr(topk, "GROUP_BYTES", size)
        assert {tuple(r) for r in topk.exact_top_k(df).collect()} == want
