"""Every query of the relational engine, with the SQL that DuckDB runs against the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import aggregates, scalars
from skerry.operators import catalog as operators
from skerry.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def tpch_q1(spark: SparkSession, folder: str) -> DataFrame:
    """Pricing summary: scan with pushed filter, one partial and one final aggregate."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        table(spark, folder, "lineitem")
        .filter(F.col("l_shipdate") <= F.expr("TIMESTAMP_NTZ '1998-09-02'"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
            F.round(F.sum(price), 2).alias("sum_disc_price"),
            F.round(F.sum(price * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
            F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
            F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
            F.round(F.avg("l_discount"), 4).alias("avg_disc"),
            F.count("*").alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


TPCH_Q1 = """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price,
       round(avg(l_discount), 4) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL ORDER BY 1, 2
"""


def _base(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """A base projection over its table, read from the folder; the scan is pruned to the columns an entry uses."""
    source = text.rsplit(" ", 1)[1]
    columns = text[len("SELECT ") : -len(f" FROM {source}")]
    return spark.sql(f"SELECT {columns} FROM {{t}}", t=table(spark, folder, source))


def _scalar(name: str) -> Query:
    entry = (scalars.SCALARS | scalars.UNCHECKED)[name]
    return lambda spark, folder: scalars.project(_base(spark, folder, scalars.BASES[entry.base]), name)


def _aggregate(name: str) -> Query:
    return lambda spark, folder: aggregates.aggregate(_base(spark, folder, aggregates.BASE), name)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {"tpch_q1": tpch_q1} | operators.QUERIES
    found |= {f"fn_{n}": _scalar(n) for n in (*scalars.SCALARS, *scalars.UNCHECKED)}
    found |= {f"agg_{n}": _aggregate(n) for n in aggregates.AGGREGATES}
    return found


def oracle_sql() -> dict[str, str]:
    found = {"tpch_q1": TPCH_Q1} | operators.SQL
    found |= {f"fn_{n}": scalars.duck_sql(n) for n in scalars.SCALARS}
    found |= {f"agg_{n}": aggregates.duck_sql(n) for n in aggregates.AGGREGATES}
    return found
