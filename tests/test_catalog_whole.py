"""No registered query reads a subset of its tables to be cheap; unmatched rows come from key expressions."""

import os
import re

import pytest

from skerry import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")
FAMILIES = ("row_posexplode", "join_null_aware_anti", "join_broadcast_", "join_shuffle_hash_", "join_merge_", "set_")


def test_no_query_filters_by_id():
    texts = {n: s for n, s in catalog.oracle_sql().items() if n.startswith(FAMILIES)}
    assert len(texts) == 25
    for name, text in texts.items():
        assert not re.search(r"WHERE \w+key (%|<)|WHERE vec_id", text), name


def test_whole_tables_are_read(spark):
    queries, size = catalog.queries(), {n: spark.read.parquet(f"{FOLDER}/{n}.parquet").count() for n in ("orders", "customer", "embeddings", "part")}
    assert queries["row_posexplode"](spark, FOLDER).select("vec_id").distinct().count() == size["embeddings"]
    assert queries["set_union_all"](spark, FOLDER).count() == size["orders"] + size["customer"]
    full = queries["join_merge_full"](spark, FOLDER)
    assert full.select("o_orderkey").distinct().count() == size["orders"] + 1 and full.filter("c_custkey IS NULL").count() > 0 < full.filter("o_orderkey IS NULL").count()
    assert 0 < queries["join_null_aware_anti"](spark, FOLDER).count() < size["part"]
