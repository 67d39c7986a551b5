"""Readers for the test tables and for plain Parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Schemas by application and path: files are opened for their schema once, not for every query.
_schemas: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``; a file and a folder of part files read alike."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    known = (spark.sparkContext.applicationId, path)
    if known not in _schemas:
        _schemas[known] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[known]).parquet(path)
