"""Split-block Bloom filters as tables: built by one aggregate, merged by another, probed by a join on the block's number.

A filter of ``blocks`` blocks has a row (block, w0..w7) for each block that some key fell into. A key sets one bit in each of
the eight 32-bit words of its block, so a probe reads one row. Null keys set nothing and match nothing. A key that was put in
is always found; others are found by chance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.operators.joins import small

WORDS = 8


def blocks_for(keys: int, bits_a_key: int = 12) -> int:
    """Blocks of 256 bits for so many keys."""
    return max(1, -(-keys * bits_a_key // 256))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    """One bit for each word, from five bits each of a second hash."""
    second = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1), F.shiftright(second, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(WORDS)]


def build(df: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter of a column's values. Partial aggregates are at most a row per block and task."""
    some = df.filter(F.col(key).isNotNull()).select(_block(F.col(key), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))])
    return some.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def merge(*filters: DataFrame) -> DataFrame:
    """The filter of all keys of several filters with the same number of blocks."""
    return reduce(DataFrame.unionByName, filters).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def probe(df: DataFrame, key: str, found: DataFrame, blocks: int, partitioned: bool = False) -> DataFrame:
    """The rows whose key may be in the filter. The filter is broadcast if its estimate is small, else, or if ``partitioned``, rows
    and filter meet by block, so no task holds more than its part of the filter."""
    bits = found.select("block", *[F.col(f"w{i}").alias(f"__w{i}") for i in range(WORDS)]).withColumnRenamed("block", "__block")
    rows = df.withColumn("__block", _block(F.col(key), blocks)).filter(F.col(key).isNotNull())
    hit = reduce(Column.__and__, [F.col(f"__w{i}").bitwiseAND(m) != 0 for i, m in enumerate(_masks(F.col(key)))])
    met = rows.join(bits.hint("merge") if partitioned else small(bits), "__block").filter(hit)
    return met.select(*[F.col(f"`{c}`") for c in df.columns])
