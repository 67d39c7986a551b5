"""Each rewrite against its plain form, on rows with nulls and duplicates."""

import pytest
from pyspark.sql import functions as F

from skerry.operators import joins
from skerry.plans import report, rewrites


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def fact(spark):
    data = [(1, 10, 5), (1, 10, 6), (1, 11, None), (2, 10, 7), (2, None, 8), (None, 10, 9), (None, None, None), (3, 12, 1), (3, 12, 1)]
    return spark.createDataFrame(data, "k int, v int, x int").cache()


@pytest.fixture(scope="module")
def dim(spark):
    return spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "c"), (5, "d")], "k int, g string").cache()


def test_self_join(fact):
    plain = fact.alias("a").join(fact.alias("b"), F.expr("a.k = b.k AND a.v <> b.v")).select("a.k").distinct()
    assert rows(rewrites.exists_distinct_pair(fact, "k", "v")) == rows(plain)


def test_filtered_aggregates(fact):
    got = rewrites.multi_filter_agg(fact, {"a": (F.col("v") == 10, F.col("x")), "b": (F.col("k") == 99, F.col("x")), "c": (F.col("x") > 6, F.col("k"))})
    want = tuple(fact.filter(c).agg(F.sum(v)).first()[0] for c, v in (("v = 10", "x"), ("k = 99", "x"), ("x > 6", "k")))
    assert rows(got) == [want]
    with pytest.raises(rewrites.Declined):
        rewrites.multi_filter_agg(fact, {})


def test_eager_aggregate_and_weights(fact, dim):
    plain = fact.join(dim, "k").groupBy("g").agg(F.sum("x").alias("s"), F.count("x").alias("n"), F.min("v").alias("m"))
    got = rewrites.eager_aggregate(fact, ["k"], {"s": ("sum", "x"), "n": ("count", "x"), "m": ("min", "v")}, lambda p: p.join(dim, "k"), ["g"])
    assert rows(got) == rows(plain)
    with pytest.raises(rewrites.Declined):
        rewrites.eager_aggregate(fact, ["k"], {"s": ("avg", "x")}, lambda p: p, ["g"])
    weighted = rewrites.weighted_dimension(dim, ["k"])
    assert rows(fact.join(weighted, "k").groupBy("k").agg(F.sum(F.col("x") * F.col("weight")).alias("s"), F.sum("weight").alias("n"))) == rows(fact.join(dim, "k").groupBy("k").agg(F.sum("x").alias("s"), F.count("*").alias("n")))


def test_semi_joins(fact, dim):
    for anti in (False, True):
        assert rows(rewrites.distinct_below_semi(fact, dim, ["k"], anti)) == rows(fact.join(dim, "k", "left_anti" if anti else "left_semi"))
    reduced = rewrites.reduce_before_aggregate(fact, dim, F.col("g") == "a", "k", "k")
    assert rows(reduced) == rows(fact.filter("k IN (1, 2)"))


def test_rollup_chain(fact):
    got = rewrites.rollup_chain(fact, ["k", "v"], {"s": ("sum", "x"), "n": ("count", "x"), "m": ("max", "x")})
    plain = fact.rollup("k", "v").agg(F.sum("x").alias("s"), F.count("x").alias("n"), F.max("x").alias("m"), F.grouping_id().cast("int").alias("gid"))
    assert rows(got) == rows(plain)


def test_not_in(spark, fact, dim):
    fact.createOrReplaceTempView("fact")
    dim.createOrReplaceTempView("dim")
    for keep in ("true", "g <> 'c'", "g = 'zzz'"):
        plain = spark.sql(f"SELECT * FROM fact WHERE k NOT IN (SELECT k FROM dim WHERE {keep})")
        assert rows(joins.null_aware_anti(fact, dim.filter(keep), "k", "k")) == rows(plain)


def test_broadcast_only_behind_a_size_check(spark, dim):
    assert "ResolvedHint" in joins.small(dim)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in joins.small(dim, 1)._jdf.queryExecution().analyzed().toString()
    with pytest.raises(rewrites.Declined):
        rewrites.broadcast_by_size(dim, 1)


def test_report(spark):
    df = spark.range(10).crossJoin(spark.range(3).toDF("b")).select(F.udf(lambda x: x, "long")("id"))
    found = report.reasons(df)
    assert found.get("BatchEvalPython") == "row-at-a-time Python function"
    assert any(e["operator"].startswith("Range") for e in report.explain(df))


def test_local_pre_aggregate(spark, fact):
    from skerry.operators import preaggregate

    aggs = {"s": ("sum", "x"), "n": ("count", "x"), "m": ("max", "v")}
    plain = fact.groupBy("k").agg(F.sum("x").alias("s"), F.count("x").alias("n"), F.max("v").alias("m"))
    for first, most in ((50_000, 0.5), (1, 0.0), (1, 1.0)):
        partial = preaggregate.local_pre_aggregate(fact, ["k"], aggs, first, most)
        assert "Exchange" not in partial._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
        assert rows(preaggregate.finish(partial, ["k"], aggs)) == rows(plain)
    many = spark.range(0, 40_000, 1, 1).selectExpr("id", "id % 7 AS k", "1 AS one")
    assert preaggregate.local_pre_aggregate(many, ["k"], {"n": ("sum", "one")}, 1000).count() == 7
    assert preaggregate.local_pre_aggregate(many, ["id"], {"n": ("sum", "one")}, 1000).count() == 40_000, "it gives up and passes rows on"
    with pytest.raises(rewrites.Declined):
        preaggregate.local_pre_aggregate(fact, ["k"], {"a": ("avg", "x")})


def test_bloom_filters(spark):
    from skerry.functions import bloom

    keys = spark.range(0, 20_000, 2).selectExpr("id AS k").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k"))
    blocks = bloom.blocks_for(10_000)
    found = bloom.build(keys, "k", blocks)
    every = spark.range(20_001).selectExpr("IF(id < 20000, id, NULL) AS k", "id AS block")
    for partitioned in (False, True):
        seen = {r.k for r in bloom.probe(every, "k", found, blocks, partitioned).collect()}
        assert seen >= set(range(0, 20_000, 2)) and len(seen) < 10_000 + 500, "no false negative, few false positives"
    halves = bloom.merge(bloom.build(keys.filter("k < 9000"), "k", blocks), bloom.build(keys.filter("k >= 9000"), "k", blocks))
    assert rows(halves) == rows(found)
    assert bloom.probe(every, "k", bloom.build(keys.limit(0), "k", blocks), blocks).count() == 0


def test_runtime_filter_and_skew_join_are_planned(spark):
    from skerry import catalog

    plan = lambda df: df._jdf.queryExecution().toString()
    bloomed = catalog.queries()["join_runtime_bloom_filter"](spark, "/root/testdata/sf0.001")
    assert "might_contain" in plan(bloomed) and "bloom_filter_agg" in plan(bloomed)
    own = spark.newSession()
    for name, value in {"autoBroadcastJoinThreshold": "-1", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "adaptive.skewJoin.skewedPartitionFactor": "1.5", "adaptive.advisoryPartitionSizeInBytes": "4k", "adaptive.coalescePartitions.enabled": "false"}.items():
        own.conf.set(f"spark.sql.{name}", value)
    left = own.range(0, 60_000, 1, 8).selectExpr("IF(id % 3 <> 0, 1, id) AS k", "id AS v")
    joined = left.join(own.range(0, 60_000, 1, 8).selectExpr("id AS k", "id AS w").hint("merge"), "k")
    assert joined.count() == 60_000
    joined.collect()
    assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
