"""Joins of every type and strategy.

Broadcasting is asked for only behind a check of the plan's size estimate; beyond it the join shuffles, and adaptive
execution splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest estimated size, in bytes, of a side that is broadcast.
BROADCAST_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its estimate is within the limit, else as it is."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def join(left: DataFrame, right: DataFrame, on, how: str = "inner", strategy: str | None = None) -> DataFrame:
    """``strategy``: broadcast (size-checked), shuffle_hash, merge, shuffle_replicate_nl, or None for Spark's choice."""
    if strategy == "broadcast":
        right = small(right)
    elif strategy:
        right = right.hint(strategy)
    return left.join(right, on, how)


def null_aware_anti(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """``left_key NOT IN (right_key)``: an empty right side keeps all rows; a null there keeps none; a null on the left is kept
    only against an empty right side. The right side is reduced to its distinct keys first."""
    keys = right.select(F.col(right_key).alias("__k")).distinct()
    facts = keys.agg(F.count("*").alias("__n"), F.count_if(F.col("__k").isNull()).alias("__nulls"))
    kept = left.join(keys.filter("__k IS NOT NULL"), F.col(left_key) == F.col("__k"), "left_anti")
    kept = kept.crossJoin(F.broadcast(facts))  # one row
    return kept.filter((F.col("__n") == 0) | ((F.col("__nulls") == 0) & F.col(left_key).isNotNull())).drop("__n", "__nulls")


def existence(left: DataFrame, right: DataFrame, keys: list[str], flag: str = "found") -> DataFrame:
    """EXISTS as a value column."""
    marked = right.select(*keys).distinct().withColumn(flag, F.lit(True))
    return left.join(marked, keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def range_residual(left: DataFrame, right: DataFrame, on: Column, low: Column, high: Column) -> DataFrame:
    """An equi-join whose matches also satisfy ``low <= high``, tested on matches inside the join."""
    return left.join(right, on & (low <= high))


def interval_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Points within ranges, as an equi-join on bins of ``width`` and an exact test: a range goes under every bin it meets."""
    bins = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    right = ranges.filter(F.col(low) <= F.col(high)).withColumn("__bin", F.explode(bins))
    left = points.withColumn("__bin", F.floor(F.col(at) / width))
    return left.join(right, "__bin").filter((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("__bin")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Each left row with the latest right value at or before it: one union, one window, no join by inequality."""
    from pyspark.sql import Window

    rows = left.withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__left", F.lit(True))
    other = right.select(*keys, at, F.col(value).alias("__v")).withColumn("__left", F.lit(False))
    met = rows.unionByName(other, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(F.col(at), F.col("__left")).rowsBetween(Window.unboundedPreceding, 0)
    return met.withColumn(value, F.last("__v", True).over(order)).filter("__left").drop("__v", "__left")
