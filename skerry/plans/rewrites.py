"""Rewrites that Spark's optimizer does not make, as DataFrame functions with their preconditions.

Each returns what the plain form returns, nulls and duplicates included. A precondition that does not hold raises
``Declined`` with the reason; the caller then keeps the plain form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.operators.joins import estimated_bytes


class Declined(ValueError):
    """Why a rewrite does not apply."""


#: Aggregates that can be finished from partial results: name -> (partial, final).
DECOMPOSABLE = {"sum": ("sum", "sum"), "count": ("count", "sum"), "min": ("min", "min"), "max": ("max", "max")}


def exists_distinct_pair(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with two different values: the self-join ``k = k AND v <> v`` as one aggregate. Null keys and values never match."""
    some = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
    return some.groupBy(key).agg(F.min(value).alias("__a"), F.max(value).alias("__b")).filter("__a <> __b").select(key)


def multi_filter_agg(df: DataFrame, parts: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Global aggregates of one input under different filters in one pass: name -> (filter, value to be summed)."""
    if not parts:
        raise Declined("no aggregates")
    any_of = None
    for keep, _ in parts.values():
        any_of = keep if any_of is None else any_of | keep
    return df.filter(any_of).agg(*[F.sum(F.when(keep, value)).alias(name) for name, (keep, value) in parts.items()])


def shared_aggregate(df: DataFrame, keys: list[str], aggregates: list[Column], not_null: str) -> tuple[DataFrame, DataFrame]:
    """(all groups, groups with a non-null key column) from one aggregate whose exchange both reuse."""
    if not_null not in keys:
        raise Declined(f"{not_null} is not a grouping key")
    once = df.groupBy(*keys).agg(*aggregates)
    return once, once.filter(F.col(not_null).isNotNull())


def reduce_before_aggregate(fact: DataFrame, dimension: DataFrame, keep: Column, fact_key: str, dimension_key: str) -> DataFrame:
    """Fact rows whose key is in the filtered dimension, so an aggregate grouped by that key reads nothing else. Also the form of
    a transitive filter: the dimension may itself be reduced by a third table first."""
    return fact.join(dimension.filter(keep).select(F.col(dimension_key).alias(fact_key)).distinct(), fact_key, "left_semi")


def prefilter_by_keys(large: DataFrame, selective: DataFrame, key: str, ratio: float = 10.0) -> DataFrame:
    """The larger side reduced to the other side's keys ahead of a join; declined unless it is ``ratio`` times larger."""
    if estimated_bytes(large) < ratio * estimated_bytes(selective):
        raise Declined(f"the large side is not {ratio:g} times the other")
    return large.join(selective.select(key).distinct(), key, "left_semi")


def narrow_below_join(dimension: DataFrame, expressions: dict[str, Column], keep: list[str]) -> DataFrame:
    """Derived columns of the smaller side computed below the join, so the join carries them and not the long strings."""
    return dimension.select(*keep, *[c.alias(n) for n, c in expressions.items()])


def _partials(aggs: dict[str, tuple[str, str]]) -> None:
    for name, (function, _) in aggs.items():
        if function not in DECOMPOSABLE:
            raise Declined(f"{function} of {name} cannot be finished from partial results")


def eager_aggregate(fact: DataFrame, join_keys: list[str], aggs: dict[str, tuple[str, str]], joined, group: list[str]) -> DataFrame:
    """Aggregate the fact by its join keys first, join the partial rows with ``joined(partial)``, and finish by ``group``.

    ``aggs``: output name -> (sum, count, min or max; fact column)."""
    _partials(aggs)
    partial = fact.groupBy(*join_keys).agg(*[getattr(F, DECOMPOSABLE[f][0])(c).alias(n) for n, (f, c) in aggs.items()])
    done = joined(partial).groupBy(*group)
    return done.agg(*[getattr(F, DECOMPOSABLE[f][1])(n).alias(n) for n, (f, _) in aggs.items()])


def weighted_dimension(df: DataFrame, columns: list[str], weight: str = "weight") -> DataFrame:
    """Distinct rows of the columns with their number: above a join, ``sum(x)`` becomes ``sum(x * weight)`` and ``count(*)``
    ``sum(weight)``."""
    return df.groupBy(*columns).agg(F.count("*").alias(weight))


def distinct_below_semi(left: DataFrame, right: DataFrame, keys: list[str], anti: bool = False) -> DataFrame:
    """A semi or anti join against the right side's distinct keys."""
    return left.join(right.select(*keys).dropDuplicates(), keys, "left_anti" if anti else "left_semi")


def group_by_unique_key(df: DataFrame, key: str, dependent: list[str], *aggregates: Column) -> DataFrame:
    """Grouping columns that the key determines are read with ``first`` instead of being grouped by. The caller vouches that
    ``key`` is the unique key of the side that ``dependent`` comes from."""
    if key in dependent:
        raise Declined("the key is among the dependent columns")
    return df.groupBy(key).agg(*[F.first(c).alias(c) for c in dependent], *aggregates)


def broadcast_by_size(df: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """A broadcast hint if the estimated size is within the limit."""
    size = estimated_bytes(df)
    if size > limit:
        raise Declined(f"{size} bytes are more than {limit}")
    return F.broadcast(df)


def rollup_chain(df: DataFrame, keys: list[str], aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """ROLLUP from its finest groups: each coarser level aggregates the level below it, not the input. Adds ``gid``."""
    _partials(aggs)
    level = df.groupBy(*keys).agg(*[getattr(F, DECOMPOSABLE[f][0])(c).alias(n) for n, (f, c) in aggs.items()])
    out = level.withColumn("gid", F.lit(0))
    for n in range(len(keys) - 1, -1, -1):
        final = [getattr(F, DECOMPOSABLE[f][1])(name).alias(name) for name, (f, _) in aggs.items()]
        level = level.groupBy(*keys[:n]).agg(*final)
        gone = [F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys[n:]]
        out = out.unionByName(level.select(*keys[:n], *gone, *aggs, F.lit((1 << (len(keys) - n)) - 1).alias("gid")))
    return out
