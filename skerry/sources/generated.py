"""A DataSource V2 source in Python: rows of a rule, split into ranges that tasks produce independently as Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.rows = int(options.get("rows", "1000"))
        self.parts = max(1, int(options.get("partitions", "4")))

    def partitions(self) -> list[_Range]:
        step = -(-self.rows // self.parts) or 1
        return [_Range(at, min(at + step, self.rows)) for at in range(0, self.rows, step)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator:
        import pyarrow as pa

        for at in range(partition.low, partition.high, 10_000):
            ids = list(range(at, min(at + 10_000, partition.high)))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([i * i % 97 for i in ids], pa.int64())], names=["id", "square"])


class GeneratedSource(DataSource):
    """``spark.read.format("skerry_generated").option("rows", n).option("partitions", p).load()``; register it first with
    ``spark.dataSource.register(GeneratedSource)``."""

    @classmethod
    def name(cls) -> str:
        return "skerry_generated"

    def schema(self) -> str:
        return "id long, square long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
