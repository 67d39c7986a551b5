"""Row-wise operators, sorts, limits and set operations as thin functions over DataFrames; Catalyst plans them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(df: DataFrame, fraction: float, seed: int, replace: bool = False) -> DataFrame:
    """Bernoulli (or, with replacement, Poisson) sampling by row, repeatable for a seed and partitioning."""
    return df.sample(replace, fraction, seed)


def generate(df: DataFrame, values: Column, alias: str = "value", position: str | None = None, outer: bool = False) -> DataFrame:
    """One row per element: explode or posexplode, with rows for empty and null arrays if ``outer``."""
    if position:
        return df.select("*", (F.posexplode_outer if outer else F.posexplode)(values).alias(position, alias))
    return df.select("*", (F.explode_outer if outer else F.explode)(values).alias(alias))


def expand(df: DataFrame, projections: list[list[Column]], names: list[str]) -> DataFrame:
    """One output row per projection and input row, in one pass over the input."""
    rows = F.array(*[F.struct(*[c.alias(n) for c, n in zip(p, names, strict=True)]) for p in projections])
    return df.select(F.inline(rows))


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """Each task keeps its n best rows, and one merge of those follows: no global sort."""
    return df.orderBy(*order).limit(n)


def offset_limit(df: DataFrame, n: int, skip: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(n)


def repartitioned(df: DataFrame, n: int, *keys: str, ranged: bool = False) -> DataFrame:
    if ranged:
        return df.repartitionByRange(n, *keys)
    return df.repartition(n, *keys)


def grouped_sets(df: DataFrame, sets: list[list[str]], keys: list[str], *aggregates: Column) -> DataFrame:
    """GROUPING SETS with ``grouping_id``."""
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(*aggregates, F.grouping_id().alias("gid"))
