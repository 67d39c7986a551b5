"""The aggregate function surface, grouped by return flag over line items; each entry is (Spark, type, DuckDB or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = (
    "SELECT l_returnflag AS g, l_linestatus AS h, l_orderkey AS o, l_partkey AS p, CAST(l_quantity AS INT) AS q, l_quantity AS dq, l_extendedprice AS x, CAST(l_extendedprice AS DECIMAL(15,2)) AS m, "
    "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_suppkey END AS n, l_linestatus = 'F' AS b, CAST(l_shipdate AS DATE) AS d, l_discount AS y FROM lineitem"
)

AGGREGATES: dict[str, tuple[str, str, str | None]] = {
    "count_star": ("count(*)", "bigint", None),
    "count_column": ("count(n)", "bigint", None),
    "count_several": ("count(n, p)", "bigint", "count(CASE WHEN n IS NOT NULL AND p IS NOT NULL THEN 1 END)"),
    "count_if": ("count_if(q > 10)", "bigint", None),
    "sum_double": ("sum(x)", "double", None),
    "sum_integral": ("sum(q)", "bigint", None),
    "try_sum": ("try_sum(q)", "bigint", "sum(q)"),
    "sum_decimal": ("sum(m)", "decimal(25,2)", None),
    "avg": ("avg(q)", "double", None),
    "try_avg": ("try_avg(n)", "double", "avg(n)"),
    "avg_decimal": ("avg(m)", "decimal(19,6)", "round(sum(m)::DECIMAL(38,10) / count(m), 6)"),
    "min_max": ("max(q) * 1000 + min(q)", "int", None),
    "min_max_string": ("concat(min(h), max(h))", "string", "min(h) || max(h)"),
    "min_max_date": ("datediff(max(d), min(d))", "int", "date_diff('day', min(d), max(d))"),
    "min_max_collated": ("CAST(max(h COLLATE UTF8_LCASE) AS STRING)", "string", "max(h)"),
    "bool_and": ("bool_and(b)", "boolean", None),
    "bool_or": ("bool_or(b)", "boolean", None),
    "every_any": ("every(q > 0) AND any(b) AND some(b)", "boolean", "bool_and(q > 0) AND bool_or(b) AND bool_or(b)"),
    "bit_and_or_xor": ("bit_and(q) + bit_or(q) * 1000 + bit_xor(q) * 1000000", "bigint", None),
    "first_any_value": ("first(g) || any_value(g) || first_value(g, true)", "string", "any_value(g) || any_value(g) || any_value(g)"),
    "last_value": ("last(g) || last_value(g)", "string", "any_value(g) || any_value(g)"),
    "first_ignores_nulls": ("first(IF(p % 2 = 0, g || 'x', NULL), true) || first_value(IF(p % 5 = 0, length(h), NULL), true)", "string", "any_value(g) || 'x1'"),
    "any_value_ignores_nulls": ("any_value(IF(p % 3 = 1, length(g) + 40, NULL), true)", "int", "any_value(length(g) + 40)"),
    "last_ignores_nulls": ("last(IF(p % 2 = 0, NULL, g || 'y'), true)", "string", "any_value(g || 'y')"),
    "try_sum_overflow": ("try_sum(CAST(9223372036854775807 AS BIGINT) - q)", "bigint", "CASE WHEN count(*) > 1 THEN NULL ELSE max(9223372036854775807 - q) END"),
    "min_max_boolean": ("min(b) OR max(b)", "boolean", "bool_and(b) OR bool_or(b)"),
    "min_max_binary": ("concat_ws('-', hex(min(CAST(h AS BINARY))), hex(max(CAST(h || q AS BINARY))))", "string", "hex(encode(min(h))) || '-' || hex(encode(max(h || q)))"),
    "max_collated_decides": ("CAST(max((CASE WHEN p % 2 = 0 THEN 'a' ELSE 'B' END) COLLATE UTF8_LCASE) AS STRING)", "string", "'B'"),
    "min_collated_decides": ("CAST(min((CASE WHEN p % 2 = 0 THEN 'a' ELSE 'B' END) COLLATE UTF8_LCASE) AS STRING)", "string", "'a'"),
    "min_max_nan": ("concat_ws('-', CAST(isnan(max(IF(p % 2 = 0, CAST('NaN' AS DOUBLE), x))) AS STRING), CAST(isnan(min(IF(p % 2 = 0, CAST('NaN' AS DOUBLE), x))) AS STRING))", "string", "'true-false'"),
    "max_by": ("max_by(o, struct(x, o, p))", "bigint", "arg_max(o, (x, o, p))"),
    "min_by": ("min_by(o, struct(x, o, p))", "bigint", "arg_min(o, (x, o, p))"),
    "stddev_samp": ("stddev(x)", "double", None),
    "stddev_pop": ("stddev_pop(x)", "double", None),
    "var_samp": ("variance(q)", "double", None),
    "var_pop": ("var_pop(q)", "double", None),
    "skewness": ("skewness(q)", "double", "(avg(dq*dq*dq) - 3*avg(dq)*avg(dq*dq) + 2*avg(dq)*avg(dq)*avg(dq)) / power(var_pop(dq), 1.5)"),
    "kurtosis": ("kurtosis(q)", "double", "kurtosis_pop(q)"),
    "covar_samp": ("covar_samp(dq, y)", "double", None),
    "covar_pop": ("covar_pop(dq, y)", "double", None),
    "corr": ("corr(dq, x)", "double", None),
    **{f"regr_{f}": (f"regr_{f}(x, dq)", "double", None) for f in ("slope", "intercept", "count", "avgx", "avgy", "r2")},
    "regr_sums": ("regr_sxx(y, dq) + regr_syy(y, dq) + regr_sxy(y, dq)", "double", None),
    "collect_list": ("array_join(sort_array(collect_list(q)), ',')", "string", "array_to_string(list_sort(list(q)), ',')"),
    "collect_set": ("array_join(sort_array(collect_set(q)), ',')", "string", "array_to_string(list_sort(list(DISTINCT q)), ',')"),
    "filter_clause": ("sum(q) FILTER (WHERE b) - count(*) FILTER (WHERE y > 0.05)", "bigint", None),
    "count_distinct": ("count(DISTINCT p)", "bigint", None),
    "sum_distinct": ("sum(DISTINCT q)", "bigint", None),
    "several_distinct": ("count(DISTINCT p) * 1000 + count(DISTINCT q)", "bigint", None),
    "count_distinct_pair": ("count(DISTINCT p, q)", "bigint", "count(DISTINCT (p, q))"),
    "percentile": ("percentile(q, 0.5)", "double", "quantile_cont(q, 0.5)"),
    "median_mode": ("median(q)", "double", "median(q)"),
    "listagg": ("listagg(DISTINCT h, ',') WITHIN GROUP (ORDER BY h)", "string", "array_to_string(list_sort(list(DISTINCT h)), ',')"),
}


def aggregate(base: DataFrame, name: str) -> DataFrame:
    text, kind, _ = AGGREGATES[name]
    value = F.expr(text)
    value = F.round(value.cast("double"), 4) if kind == "double" else value.cast(kind)
    return base.groupBy("g").agg(value.alias("v"))


def duck_sql(name: str) -> str:
    text, kind, duck = AGGREGATES[name]
    kind = {"string": "VARCHAR"}.get(kind, kind)
    value = f"round(CAST({duck or text} AS DOUBLE), 4)" if kind == "double" else f"CAST({duck or text} AS {kind})"
    return f"SELECT g, {value} AS v FROM ({BASE}) GROUP BY g"
