"""Sinks: partitioned, bucketed and size-limited Parquet, written by Spark's committers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None, max_records: int | None = None, sort_within: list[str] | None = None, cluster: bool = True, **options: str) -> None:
    """``partition_by`` folders get few large files: rows are rebalanced by the partition columns, and adaptive execution
    splits a partition that holds a large share of the rows."""
    if partition_by and cluster:
        df = df.hint("rebalance", *partition_by)
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    writer = df.write.mode(mode).options(**options)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_bucketed(df: DataFrame, name: str, buckets: int, keys: list[str], sort_by: list[str] | None = None, mode: str = "overwrite", path: str | None = None) -> None:
    """A table whose joins and aggregates on ``keys`` need no exchange; with ``path``, its files are there and not in the warehouse."""
    writer = df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*(sort_by or keys))
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
