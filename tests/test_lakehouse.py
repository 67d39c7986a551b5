import pytest
from pyspark.sql import functions as F

from skerry.sources.lakehouse import Clause, SnapshotTable, merge_rows


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions_and_deletes(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    first = spark.createDataFrame([(1, "a", 0.0), (2, None, -0.0), (3, "c", None)], "id int, name string, x double")
    t.append(first)
    t.append(spark.createDataFrame([(4, "d", 1.0)], first.schema))
    t.delete(F.col("id") == 4, "merge-on-read")
    assert [r[0] for r in rows(t.read())] == [1, 2, 3]
    t.delete_keys(spark.createDataFrame([(0.0,)], "x double"))
    assert [r[0] for r in rows(t.read())] == [2, 3], "-0.0 is another key than 0.0"
    t.append(spark.createDataFrame([(5, None, 0.0)], first.schema))
    t.delete_keys(spark.createDataFrame([(None,)], "name string"))
    assert [r[0] for r in rows(t.read())] == [3], "null equals null; later files are not touched by the earlier delete"
    assert len(rows(t.read(2))) == 4 and t.versions() == list(range(1, 7))
    assert {r[0] for r in rows(t.read(deleted_flag="gone")) if r[3]} == {1, 2, 4, 5}
    t.update(F.col("id") == 3, {"name": F.lit("z")})
    assert rows(t.read()) == [(3, "z", None)]
    t.compact()
    assert rows(t.read()) == [(3, "z", None)] and all(e["kind"] == "data" for e in t.manifest())
    wide = spark.createDataFrame([], "id long, name string, x double, extra int").schema
    assert rows(t.read(schema=wide)) == [(3, "z", None, None)]
    t.delete(F.col("id") == 3)
    assert rows(t.read(schema=wide)) == []


def test_tags_and_rollback(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.append(spark.range(3).toDF("id"))
    t.tag("good")
    t.overwrite(spark.range(1).toDF("id"))
    assert t.read().count() == 1 and t.read(t.tagged("good")).count() == 3
    t.rollback(t.tagged("good"))
    assert t.read().count() == 3


def test_merge_clauses_in_order(spark):
    target = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (None, 40)], "id int, v int")
    source = spark.createDataFrame([(1, 100), (2, None), (5, 500), (None, 600)], "id int, v int")
    clauses = [Clause("matched", "delete", "s.v IS NULL"), Clause("matched", "update", None, {"v": "s.v + t.v"}), Clause("not_matched", "insert", "s.id IS NOT NULL"), Clause("not_matched_by_source", "update", "t.v = 30", {"v": "-1"})]
    assert rows(merge_rows(target, source, ["id"], clauses)) == [(1, 110), (3, -1), (5, 500), (None, 40)]
    twice = spark.createDataFrame([(1, 1), (1, 2)], "id int, v int")
    with pytest.raises(Exception, match="MERGE_CARDINALITY_VIOLATION"):
        merge_rows(target, twice, ["id"], clauses).collect()


def test_merge_rewrites_touched_files_only(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.append(spark.range(0, 1000).selectExpr("id", "id AS v").repartitionByRange(5, "id"))
    before = {e["path"] for e in t.manifest()}
    source = spark.createDataFrame([(3, 33), (5, 55), (-1, 1)], "id long, v long")
    t.merge(source, ["id"], [Clause("matched", "delete", "t.id = 5"), Clause("matched", "update", None, {"v": "s.v"}), Clause("not_matched", "insert")])
    after = {e["path"] for e in t.manifest()}
    assert len(before & after) == 4 and t.read().count() == 1000
    assert rows(t.read().filter("id < 7")) == sorted([(-1, 1), (0, 0), (1, 1), (2, 2), (3, 33), (4, 4), (6, 6)], key=str)
    t.merge(source.limit(0), ["id"], [Clause("not_matched_by_source", "delete", "t.id >= 900")])
    assert t.read().filter("id >= 900").count() == 0 and t.read().count() == 900
    t.merge(spark.createDataFrame([(5000, 1)], "id long, v long"), ["id"], [Clause("not_matched", "insert")])
    assert t.read().count() == 901
