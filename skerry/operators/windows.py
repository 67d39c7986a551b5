"""Window specifications and the group limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spec(keys: list[str], order: list, rows: tuple | None = None, values: tuple | None = None):
    """A specification; ``rows`` or ``values`` are frame bounds, None in them is unbounded."""
    w = Window.partitionBy(*keys).orderBy(*order) if order else Window.partitionBy(*keys)
    ends = lambda b: (Window.unboundedPreceding if b[0] is None else b[0], Window.unboundedFollowing if b[1] is None else b[1])
    if rows:
        return w.rowsBetween(*ends(rows))
    if values:
        return w.rangeBetween(*ends(values))
    return w


def best_of_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank=F.row_number, name: str = "rank") -> DataFrame:
    """The n best rows of each group: Spark limits groups in each task before the exchange."""
    return df.withColumn(name, rank().over(spec(keys, order))).filter(F.col(name) <= n)
