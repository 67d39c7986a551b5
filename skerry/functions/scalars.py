"""The scalar function surface: every expression the engine promises, with the SQL that an independent engine agrees on.

Each entry names a base projection, the Spark expression, the result type and the DuckDB expression (None: the same text).
Expressions stay built-in, so each is one code-generated projection over a pruned scan.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Scalar(NamedTuple):
    base: str
    spark: str
    kind: str
    duck: str | None = None


#: Base projections, valid in both engines; ``k`` tells rows apart.
BASES = {
    "part": "SELECT p_partkey AS k, p_name AS name, p_brand AS brand, p_type AS ptype, p_size AS size, p_retailprice AS price, CAST(p_retailprice AS DECIMAL(15,2)) AS money, "
    "CAST(p_retailprice AS DECIMAL(30,10)) AS wide, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS ns, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END AS nt, "
    "p_size % 2 = 0 AS even, CASE WHEN p_size % 4 = 0 THEN CAST('NaN' AS DOUBLE) ELSE p_retailprice END AS x, p_size - 25 AS i, (p_size - 25) / 10.0 AS f FROM part",
    "orders": "SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, o_totalprice AS price, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderpriority AS pr, "
    "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS nd FROM orders",
    "nested": "SELECT vec_id AS k, embedding AS a, label FROM embeddings",
}

_P, _O, _N = "part", "orders", "nested"

SCALARS: dict[str, Scalar] = {
    # core, predicates, conditionals
    "column_reference": Scalar(_P, "name", "string"),
    "alias": Scalar(_P, "size AS v0", "int"),
    "literal_types": Scalar(_P, "concat_ws('|', CAST(1 AS STRING), CAST(CAST(2 AS BIGINT) AS STRING), CAST(DATE'2020-02-29' AS STRING), 'x', CAST(1.50BD AS STRING))", "string", "concat_ws('|', '1', '2', CAST(DATE '2020-02-29' AS VARCHAR), 'x', CAST(1.50 AS VARCHAR))"),
    "typed_null_literal": Scalar(_P, "CAST(NULL AS INT)", "int"),
    "boolean_literal": Scalar(_P, "size > 0 AND true", "boolean"),
    "compare_lt": Scalar(_P, "size < 20", "boolean"),
    "compare_le_string": Scalar(_P, "ptype <= 'MEDIUM'", "boolean"),
    "compare_eq_nan": Scalar(_P, "x = CAST('NaN' AS DOUBLE)", "boolean"),
    "compare_gt_nan": Scalar(_P, "x > 1e300", "boolean"),
    "compare_ne": Scalar(_P, "brand <> 'Brand#11'", "boolean"),
    "compare_wide_decimal": Scalar(_P, "wide >= CAST(1500.5 AS DECIMAL(30,10))", "boolean"),
    "boolean_comparison": Scalar(_P, "even = true", "boolean"),
    "null_safe_equality": Scalar(_P, "ns <=> NULL", "boolean", "ns IS NOT DISTINCT FROM NULL"),
    "in_list": Scalar(_P, "ns IN (1, 2, 3)", "boolean"),
    "in_set": Scalar(_P, "size IN (1,2,3,4,5,6,7,8,9,10,11,12,13)", "boolean"),
    "string_in_set": Scalar(_P, "ptype IN ('ECONOMY','LARGE','a','b','c','d','e','f','g','h','i','j')", "boolean"),
    "between": Scalar(_P, "price BETWEEN 1000 AND 1500", "boolean"),
    "isnan": Scalar(_P, "isnan(x)", "boolean", "coalesce(isnan(x), false)"),
    "and_three_valued": Scalar(_P, "ns > 10 AND size > 5", "boolean"),
    "or_three_valued": Scalar(_P, "ns > 10 OR size > 40", "boolean"),
    "not": Scalar(_P, "NOT (ns > 10)", "boolean"),
    "is_null": Scalar(_P, "ns IS NULL", "boolean"),
    "is_not_null": Scalar(_P, "nt IS NOT NULL", "boolean"),
    "is_null_nested": Scalar(_P, "named_struct('a', ns) IS NULL", "boolean", "struct_pack(a := ns) IS NULL"),
    "case_when": Scalar(_P, "CASE WHEN ns < 10 THEN 'low' WHEN ns < 30 THEN 'mid' ELSE 'high' END", "string"),
    "if": Scalar(_P, "if(even, size, -size)", "int", "CASE WHEN even THEN size ELSE -size END"),
    "coalesce": Scalar(_P, "coalesce(ns, size * 100)", "int"),
    "nvl2_nullif_ifnull": Scalar(_P, "nvl2(nt, ifnull(nullif(ns, 3), -1), nvl(ns, -2))", "int", "CASE WHEN nt IS NOT NULL THEN coalesce(nullif(ns, 3), -1) ELSE coalesce(ns, -2) END"),
    "like": Scalar(_P, "ptype LIKE '%O%M%'", "boolean"),
    "like_underscore": Scalar(_P, "ptype LIKE '_ARGE'", "boolean"),
    "rlike": Scalar(_P, "ptype RLIKE '^(M|S)'", "boolean", "regexp_matches(ptype, '^(M|S)')"),
    "startswith_endswith_contains": Scalar(_P, "startswith(ptype, 'S') OR endswith(ptype, 'Y') OR contains(ptype, 'ED')", "boolean", "starts_with(ptype, 'S') OR ends_with(ptype, 'Y') OR contains(ptype, 'ED')"),
    # arithmetic and math
    "int_arithmetic": Scalar(_P, "size * 3 - i + 7", "int"),
    "try_add": Scalar(_P, "try_add(CAST(2147483600 AS INT), size)", "int", "CASE WHEN 2147483600 + size::BIGINT > 2147483647 THEN NULL ELSE 2147483600 + size::BIGINT END"),
    "try_subtract": Scalar(_P, "try_subtract(CAST(-2147483640 AS INT), size)", "int", "CASE WHEN -2147483640 - size::BIGINT < -2147483648 THEN NULL ELSE -2147483640 - size::BIGINT END"),
    "try_multiply": Scalar(_P, "try_multiply(size, 100000000)", "int", "CASE WHEN size::BIGINT * 100000000 > 2147483647 THEN NULL ELSE size::BIGINT * 100000000 END"),
    "try_divide": Scalar(_P, "try_divide(price, i)", "double", "CASE WHEN i = 0 THEN NULL ELSE price / i END"),
    "double_arithmetic": Scalar(_P, "(price * 1.1D - size) / 3.0D", "double", "(price * 1.1::DOUBLE - size) / 3.0::DOUBLE"),
    "float_arithmetic": Scalar(_P, "CAST(size AS FLOAT) * CAST(1.5 AS FLOAT)", "double", "CAST(CAST(size AS FLOAT) * CAST(1.5 AS FLOAT) AS DOUBLE)"),
    "decimal_arithmetic": Scalar(_P, "money * CAST(2.5 AS DECIMAL(3,1)) + money - CAST(1 AS DECIMAL(3,1))", "decimal(22,3)"),
    "decimal_divide": Scalar(_P, "money / CAST(4 AS DECIMAL(3,1))", "decimal(20,6)", "round(money / 4, 6)"),
    "wide_decimal_arithmetic": Scalar(_P, "wide + wide * 2", "decimal(38,10)"),
    "unary_minus": Scalar(_P, "-i", "int"),
    "abs": Scalar(_P, "abs(i)", "int"),
    "abs_wide_decimal": Scalar(_P, "abs(-wide)", "decimal(30,10)"),
    "signum": Scalar(_P, "signum(i)", "double", "sign(i)"),
    "sqrt": Scalar(_P, "sqrt(price)", "double"),
    **{f: Scalar(_P, f"{f}(f)", "double") for f in ("cbrt", "exp", "sin", "cos", "tan", "atan", "sinh", "cosh", "tanh", "asinh", "degrees", "radians")},
    "asin": Scalar(_P, "asin(f / 3)", "double"),
    "acos": Scalar(_P, "acos(f / 3)", "double"),
    "acosh": Scalar(_P, "acosh(price)", "double"),
    "atanh": Scalar(_P, "atanh(f / 3)", "double"),
    "expm1": Scalar(_P, "expm1(f)", "double", "exp(f) - 1"),
    "cot": Scalar(_P, "cot(size)", "double"),
    "sec": Scalar(_P, "sec(f)", "double", "1 / cos(f)"),
    "csc": Scalar(_P, "csc(size)", "double", "1 / sin(size)"),
    "ln": Scalar(_P, "ln(i)", "double", "CASE WHEN i > 0 THEN ln(i) END"),
    "log_base": Scalar(_P, "log(2, price)", "double", "ln(price) / ln(2)"),
    "log2": Scalar(_P, "log2(size)", "double"),
    "log10": Scalar(_P, "log10(price)", "double"),
    "log1p": Scalar(_P, "log1p(price)", "double", "ln(1 + price)"),
    "pow": Scalar(_P, "pow(size, 2.5)", "double"),
    "atan2": Scalar(_P, "atan2(i, size)", "double"),
    "hypot": Scalar(_P, "hypot(i, size)", "double", "sqrt(i * i + size * size)"),
    "remainder": Scalar(_P, "i % 7", "int"),
    "try_mod": Scalar(_P, "try_mod(size, i)", "int", "CASE WHEN i = 0 THEN NULL ELSE size % i END"),
    "pmod": Scalar(_P, "pmod(i, 7)", "int", "((i % 7) + 7) % 7"),
    "div": Scalar(_P, "i div 4", "bigint", "CAST(trunc(i / 4.0) AS BIGINT)"),
    "greatest_least": Scalar(_P, "greatest(ns, 20) - least(ns, 30)", "int"),
    "nanvl": Scalar(_P, "nanvl(x, -1D)", "double", "CASE WHEN isnan(x) THEN -1 ELSE x END"),
    "normalize_zero": Scalar(_P, "CASE WHEN -0.0D = 0.0D THEN 1 ELSE 0 END", "int", "CASE WHEN (-0.0)::DOUBLE = 0.0::DOUBLE THEN 1 ELSE 0 END"),
    "ceil_floor": Scalar(_P, "ceil(f) * 1000 + floor(f)", "bigint"),
    "rint": Scalar(_P, "rint(f * 5)", "double", "round_even(f * 5, 0)"),
    "round": Scalar(_P, "round(money, 1)", "decimal(15,1)"),
    "bround": Scalar(_P, "bround(f * 5)", "double", "round_even(f * 5, 0)"),
    "ceil_scale": Scalar(_P, "ceil(money, 1)", "decimal(16,1)", "ceil(money * 10) / 10"),
    "floor_scale": Scalar(_P, "floor(money, 1)", "decimal(16,1)", "floor(money * 10) / 10"),
    "bit_and_or_xor": Scalar(_P, "(size & 12) | (size ^ 5)", "int", "(size & 12) | xor(size, 5)"),
    "bit_not": Scalar(_P, "~size", "int"),
    "shift_left": Scalar(_P, "shiftleft(size, 3)", "int", "size << 3"),
    "shift_right": Scalar(_P, "shiftright(size, 2)", "int", "size >> 2"),
    "shift_right_unsigned": Scalar(_P, "shiftrightunsigned(CAST(size AS BIGINT), 1)", "bigint", "size >> 1"),
    "bit_count": Scalar(_P, "bit_count(i)", "int", "bit_count(i::BIGINT)"),
    # casts
    "cast_widening": Scalar(_P, "CAST(CAST(size AS BIGINT) AS DOUBLE) + 0.5D", "double", "size + 0.5"),
    "cast_narrowing": Scalar(_P, "CAST(price AS INT)", "int", "CAST(trunc(price) AS INT)"),
    "cast_byte_short": Scalar(_P, "CAST(CAST(size AS TINYINT) AS SMALLINT)", "smallint"),
    "cast_number_boolean": Scalar(_P, "CAST(i AS BOOLEAN)", "boolean"),
    "cast_boolean_number": Scalar(_P, "CAST(even AS INT)", "int"),
    "cast_string_boolean": Scalar(_P, "CAST(CASE WHEN even THEN 'true' ELSE 'no' END AS BOOLEAN)", "boolean", "even"),
    "cast_string_int": Scalar(_P, "try_cast(CASE WHEN even THEN 'abc' ELSE CAST(size AS STRING) END AS INT)", "int", "try_cast(CASE WHEN even THEN 'abc' ELSE CAST(size AS VARCHAR) END AS INT)"),
    "cast_string_double": Scalar(_P, "CAST(CAST(money AS STRING) AS DOUBLE)", "double", "CAST(money AS DOUBLE)"),
    "cast_string_date": Scalar(_O, "CAST(CAST(d AS STRING) AS DATE)", "date", "d"),
    "cast_string_timestamp": Scalar(_O, "CAST(date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS TIMESTAMP_NTZ)", "timestamp_ntz", "date_trunc('second', ts)"),
    "cast_number_string": Scalar(_P, "concat(CAST(size AS STRING), CAST(even AS STRING), CAST(money AS STRING))", "string", "CAST(size AS VARCHAR) || CAST(even AS VARCHAR) || CAST(money AS VARCHAR)"),
    "cast_date_string": Scalar(_O, "CAST(d AS STRING)", "string", "strftime(d, '%Y-%m-%d')"),
    "cast_date_timestamp": Scalar(_O, "CAST(CAST(d AS TIMESTAMP) AS TIMESTAMP_NTZ)", "timestamp_ntz", "CAST(d AS TIMESTAMP)"),
    "cast_timestamp_date": Scalar(_O, "CAST(ts AS DATE)", "date"),
    "cast_decimal": Scalar(_P, "CAST(money AS DECIMAL(15,1))", "decimal(15,1)"),
    "cast_wide_decimal": Scalar(_P, "CAST(wide AS DECIMAL(38,4))", "decimal(38,4)"),
    "cast_identity": Scalar(_P, "CAST(size AS INT)", "int"),
    # strings
    "instr_locate_position": Scalar(_P, "instr(ptype, 'O') * 100 + locate('M', ptype) + position('A' IN ptype)", "int", "instr(ptype, 'O') * 100 + instr(ptype, 'M') + instr(ptype, 'A')"),
    "replace": Scalar(_P, "replace(ptype, 'O', '<o>')", "string"),
    "translate": Scalar(_P, "translate(ptype, 'ABM', 'xy')", "string"),
    "substring_index": Scalar(_P, "substring_index(concat(brand, '#', name), '#', 2)", "string", "array_to_string(list_slice(string_split(brand || '#' || name, '#'), 1, 2), '#')"),
    "split_part": Scalar(_P, "split_part(concat(brand, '#z'), '#', 2)", "string", "split_part(brand || '#z', '#', 2)"),
    "find_in_set": Scalar(_P, "find_in_set(ptype, 'LARGE,SMALL,PROMO')", "int", "coalesce(list_position(['LARGE','SMALL','PROMO'], ptype), 0)"),
    "upper_lower": Scalar(_P, "concat(upper(name), lower(ptype))", "string", "upper(name) || lower(ptype)"),
    "initcap": Scalar(_P, "initcap(ptype)", "string", "upper(ptype[1]) || lower(ptype[2:])"),
    "trim": Scalar(_P, "concat(trim('  a '), ltrim(' b '), rtrim(' c '), btrim('xxdx', 'x'), trim(BOTH 'S' FROM ptype))", "string", "trim('  a ') || ltrim(' b ') || rtrim(' c ') || trim('xxdx', 'x') || trim(ptype, 'S')"),
    "concat": Scalar(_P, "concat(nt, '-', brand)", "string", "nt || '-' || brand"),
    "concat_ws": Scalar(_P, "concat_ws('-', nt, brand)", "string"),
    "elt": Scalar(_P, "elt(1 + size % 3, 'a', 'b', 'c')", "string", "['a','b','c'][1 + size % 3]"),
    "length_octet_bit": Scalar(_P, "length(concat(ptype, 'é')) * 10000 + octet_length(concat(ptype, 'é')) * 100 + bit_length('é')", "int", "length(ptype || 'é') * 10000 + strlen(ptype || 'é') * 100 + bit_length('é')"),
    "ascii": Scalar(_P, "ascii(ptype)", "int", "unicode(ptype)"),
    "chr": Scalar(_P, "chr(64 + size % 26)", "string", "chr(64 + size % 26)"),
    "substring_left_right": Scalar(_P, "concat(substring(ptype, 2, 3), left(ptype, 2), right(ptype, 2), substring(ptype, -3, 2))", "string", "substring(ptype, 2, 3) || left(ptype, 2) || right(ptype, 2) || substring(ptype, -3, 2)"),
    "lpad_rpad": Scalar(_P, "concat(lpad(ptype, 8, '*'), rpad(ptype, 4, '.'))", "string", "lpad(ptype, 8, '*') || rpad(ptype, 4, '.')"),
    "repeat": Scalar(_P, "repeat('ab', size % 4)", "string"),
    "space": Scalar(_P, "concat('[', space(size % 4), ']')", "string", "'[' || repeat(' ', size % 4) || ']'"),
    "overlay": Scalar(_P, "overlay(ptype PLACING 'zz' FROM 2 FOR 1)", "string", "substring(ptype, 1, 1) || 'zz' || substring(ptype, 3)"),
    "collation_compare": Scalar(_P, "ptype COLLATE UTF8_LCASE = 'large'", "boolean", "lower(ptype) = 'large'"),
    "empty_to_null": Scalar(_P, "nullif(CASE WHEN even THEN '' ELSE brand END, '')", "string"),
    # dates and times
    **{f: Scalar(_O, f"{f}(nd)", "int") for f in ("year", "month", "day", "dayofyear", "quarter", "weekofyear")},
    "dayofweek": Scalar(_O, "dayofweek(d)", "int", "dayofweek(d) + 1"),
    "weekday": Scalar(_O, "weekday(d)", "int", "(dayofweek(d) + 6) % 7"),
    "extract": Scalar(_O, "extract(YEAR FROM d) * 100 + extract(MONTH FROM d)", "int"),
    "trunc_date": Scalar(_O, "trunc(d, 'QUARTER')", "date", "CAST(date_trunc('quarter', d) AS DATE)"),
    "date_add": Scalar(_O, "date_add(d, 45)", "date", "CAST(d + INTERVAL 45 DAY AS DATE)"),
    "date_sub": Scalar(_O, "date_sub(d, 45)", "date", "CAST(d - INTERVAL 45 DAY AS DATE)"),
    "datediff": Scalar(_O, "datediff(d, DATE'1996-02-29')", "int", "date_diff('day', DATE '1996-02-29', d)"),
    "hour_minute_second": Scalar(_O, "hour(ts) * 10000 + minute(ts) * 100 + second(ts)", "int"),
    "last_day": Scalar(_O, "last_day(d)", "date"),
    "add_months": Scalar(_O, "add_months(d, 13)", "date", "CAST(d + INTERVAL 13 MONTH AS DATE)"),
    "next_day": Scalar(_O, "next_day(d, 'MO')", "date", "CAST(d + to_days(CAST(7 - (dayofweek(d) + 6) % 7 AS INT)) AS DATE)"),
    "months_between": Scalar(_O, "months_between(trunc(d, 'MM'), DATE'1995-01-01')", "double", "date_diff('month', DATE '1995-01-01', d)"),
    "make_date": Scalar(_O, "make_date(year(d), month(d), 1)", "date"),
    "unix_date": Scalar(_O, "unix_date(d)", "int", "date_diff('day', DATE '1970-01-01', d)"),
    "date_from_unix_date": Scalar(_O, "date_from_unix_date(CAST(k % 20000 AS INT))", "date", "CAST(DATE '1970-01-01' + to_days(CAST(k % 20000 AS INT)) AS DATE)"),
    "timestamp_micros": Scalar(_O, "CAST(timestamp_micros(k * 1000001) AS TIMESTAMP_NTZ)", "timestamp_ntz", "make_timestamp(k * 1000001)"),
    "timestamp_millis": Scalar(_O, "CAST(timestamp_millis(k * 1001) AS TIMESTAMP_NTZ)", "timestamp_ntz", "make_timestamp(k * 1001000)"),
    "timestamp_seconds": Scalar(_O, "CAST(timestamp_seconds(k * 11) AS TIMESTAMP_NTZ)", "timestamp_ntz", "make_timestamp(k * 11000000)"),
    "unix_micros": Scalar(_O, "unix_micros(ts)", "bigint", "epoch_us(ts)"),
    "unix_millis": Scalar(_O, "unix_millis(ts)", "bigint", "epoch_ms(ts)"),
    "unix_seconds": Scalar(_O, "unix_seconds(ts)", "bigint", "epoch_us(ts) // 1000000"),
    "date_format": Scalar(_O, "date_format(ts, 'yyyy/MM/dd HH')", "string", "strftime(ts, '%Y/%m/%d %H')"),
    "from_unixtime": Scalar(_O, "from_unixtime(k * 3600, 'yyyy-MM-dd HH:mm:ss')", "string", "strftime(make_timestamp(k * 3600000000), '%Y-%m-%d %H:%M:%S')"),
    "unix_timestamp": Scalar(_O, "unix_timestamp(ts)", "bigint", "epoch_us(ts) // 1000000"),
    "date_trunc": Scalar(_O, "CAST(date_trunc('MONTH', ts) AS TIMESTAMP_NTZ)", "timestamp_ntz", "date_trunc('month', ts)"),
    # hashes and transforms
    "md5": Scalar(_P, "md5(name)", "string"),
    "sha1": Scalar(_P, "sha1(name)", "string"),
    "sha2": Scalar(_P, "sha2(name, 256)", "string", "sha256(name)"),
    "transform_years": Scalar(_O, "year(d) - 1970", "int"),
    "transform_months": Scalar(_O, "(year(d) - 1970) * 12 + month(d) - 1", "int"),
    "transform_days": Scalar(_O, "datediff(d, DATE'1970-01-01')", "int", "date_diff('day', DATE '1970-01-01', d)"),
    "transform_hours": Scalar(_O, "CAST(floor(unix_micros(ts) / 3600000000D) AS INT)", "int", "CAST(floor(epoch_us(ts) / 3600000000.0) AS INT)"),
    "transform_truncate_int": Scalar(_P, "i - pmod(i, 10)", "int", "i - ((i % 10) + 10) % 10"),
    "transform_truncate_string": Scalar(_P, "substring(name, 1, 3)", "string"),
    # arrays, maps, structs, lambdas
    "struct_field": Scalar(_P, "named_struct('a', named_struct('b', size)).a.b", "int", "struct_pack(a := struct_pack(b := size)).a.b"),
    "size_array": Scalar(_N, "size(a)", "int", "len(a)"),
    "size_map": Scalar(_P, "cardinality(map('a', size, 'b', i))", "int", "2"),
    "array_index": Scalar(_N, "a[3]", "double", "a[4]"),
    "array_get_out_of_range": Scalar(_N, "get(a, 999)", "double", "a[1000]"),
    "map_key": Scalar(_P, "try_element_at(map('a', size), CASE WHEN even THEN 'a' ELSE 'z' END)", "int", "CASE WHEN even THEN size END"),
    "element_at": Scalar(_N, "element_at(a, -1)", "double", "a[-1]"),
    "array_contains": Scalar(_P, "array_contains(array(1, 2, ns), 5)", "boolean", "CASE WHEN ns = 5 THEN true WHEN ns IS NULL THEN NULL ELSE false END"),
    "map_contains_key": Scalar(_P, "map_contains_key(map(size, 1), 10)", "boolean", "size = 10"),
    "array_position": Scalar(_P, "array_position(array(3, 1, 2), size % 4)", "bigint", "coalesce(list_position([3, 1, 2], size % 4), 0)"),
    "array_min_max": Scalar(_N, "array_max(a) - array_min(a)", "double", "list_max(a) - list_min(a)"),
    "exists": Scalar(_N, "exists(a, x -> x > 0.3)", "boolean", "len(list_filter(a, lambda x: x > 0.3::FLOAT)) > 0"),
    "forall": Scalar(_N, "forall(a, x -> x < 0.4)", "boolean", "len(list_filter(a, lambda x: NOT (x < 0.4::FLOAT))) = 0"),
    "aggregate_fold": Scalar(_N, "aggregate(a, 0D, (s, x) -> s + x, s -> s * 2)", "double", "list_sum(list_transform(a, lambda x: x::DOUBLE)) * 2"),
    "transform_index": Scalar(_P, "aggregate(transform(array(size, i, 3), (x, j) -> x * j), 0, (s, x) -> s + x)", "int", "i + 6"),
    "filter_array": Scalar(_N, "size(filter(a, x -> x > 0))", "int", "len(list_filter(a, lambda x: x > 0))"),
    "zip_with": Scalar(_N, "aggregate(zip_with(a, a, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, x) -> s + x)", "double", "list_sum(list_transform(a, lambda x: x::DOUBLE * x::DOUBLE))"),
    "map_filter": Scalar(_P, "size(map_filter(map('a', size, 'b', i), (k2, v2) -> v2 > 10))", "int", "(size > 10)::INT + (i > 10)::INT"),
    "transform_values": Scalar(_P, "transform_values(map('a', size), (k2, v2) -> v2 + 1)['a']", "int", "size + 1"),
    "map_keys_values": Scalar(_P, "concat(array_join(map_keys(map('a', size)), ','), CAST(map_values(map('a', size))[0] AS STRING))", "string", "'a' || size::VARCHAR"),
    "slice": Scalar(_N, "array_max(slice(a, 2, 3))", "double", "list_max(a[2:4])"),
    "named_struct": Scalar(_P, "to_json(named_struct('a', size, 'b', ptype))", "string", "'{\"a\":' || size || ',\"b\":\"' || ptype || '\"}'"),
    "array_constructor": Scalar(_P, "array_join(array(name, brand), '/')", "string", "array_to_string([name, brand], '/')"),
    "map_constructor": Scalar(_P, "map(1, size, 2, i)[2]", "int", "i"),
    "if_nested_null": Scalar(_P, "if(even, NULL, array(size)) IS NULL", "boolean", "even"),
    "nested_literal": Scalar(_P, "array(1, 2, 3)[size % 3]", "int", "[1, 2, 3][1 + size % 3]"),
}

#: Expressions with no counterpart in the other engine; their rows are tested against known values.
UNCHECKED: dict[str, Scalar] = {
    "monotonically_increasing_id": Scalar(_P, "monotonically_increasing_id()", "bigint"),
    "spark_partition_id": Scalar(_P, "spark_partition_id()", "int"),
    "hash_murmur3": Scalar(_P, "hash(name, size)", "int"),
    "xxhash64": Scalar(_P, "xxhash64(name, size)", "bigint"),
    "crc32": Scalar(_P, "crc32(name)", "bigint"),
}


def scalar(name: str) -> Column:
    """The expression of one entry, over the columns of its base projection."""
    entry = (SCALARS | UNCHECKED)[name]
    value = F.expr(entry.spark.removesuffix(" AS v0"))
    return F.round(value.cast("double"), 6) if entry.kind == "double" else value.cast(entry.kind)


def project(base: DataFrame, name: str) -> DataFrame:
    """(k, v) of one entry; ``base`` has the columns of the entry's base projection."""
    return base.select("k", scalar(name).alias("v"))


def duck_sql(name: str) -> str:
    entry = SCALARS[name]
    kind = {"string": "VARCHAR", "timestamp_ntz": "TIMESTAMP"}.get(entry.kind, entry.kind)
    text = (entry.duck or entry.spark).removesuffix(" AS v0")
    value = f"round(CAST({text} AS DOUBLE), 6)" if entry.kind == "double" else f"CAST({text} AS {kind})"
    return f"SELECT k, {value} AS v FROM ({BASES[entry.base]})"
