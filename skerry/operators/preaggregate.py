"""A local pre-aggregate: one aggregate per task without an exchange, which gives up where it does not reduce.

Below a join or an exchange it sends partial rows in place of input rows. A task that finds after its first rows that groups
are nearly as many as rows passes the rest through as partial rows of one input row each, so its memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.plans.rewrites import DECOMPOSABLE, Declined

#: Rows after which a task decides, the share of groups among them above which it gives up, and the groups it holds at most.
FIRST_ROWS, MOST_GROUPS, HELD = 50_000, 0.5, 500_000


def local_pre_aggregate(df: DataFrame, keys: list[str], aggs: dict[str, tuple[str, str]], first_rows: int = FIRST_ROWS, most_groups: float = MOST_GROUPS) -> DataFrame:
    """Partial rows of ``aggs`` (name -> (sum, count, min or max; column)) by ``keys``; ``finish`` makes the groups of them."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    for name, (function, column) in aggs.items():
        if function not in DECOMPOSABLE:
            raise Declined(f"{function} of {name} cannot be finished from partial results")
        if function == "sum" and df.schema[column].dataType.simpleString() not in numeric:
            raise Declined(f"the sum of {column} is not of a plain number")
    values = {n: (F.col(c).isNotNull().cast("bigint") if f == "count" else F.col(c).cast("bigint" if df.schema[c].dataType.simpleString() in numeric[:4] else "double") if f == "sum" else F.col(c)) for n, (f, c) in aggs.items()}
    rows = df.select(*[F.col(k) for k in keys], *[v.alias(n) for n, v in values.items()])
    functions = [(n, "sum" if f in ("sum", "count") else f) for n, (f, _) in aggs.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grouped(tables: list[pa.Table]) -> pa.Table:
            done = pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate(functions)
            return done.select([*keys, *(f"{n}_{f}" for n, f in functions)]).rename_columns(tables[0].column_names).cast(tables[0].schema)

        held, pending, seen, open_ = None, [], 0, True
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names)  # every column nullable, as in partial rows
            if not open_:
                yield batch
                continue
            pending.append(pa.Table.from_batches([batch]))
            seen += batch.num_rows
            if seen >= first_rows:
                held = grouped([*([held] if held is not None else []), *pending])
                pending = []
                if held.num_rows > most_groups * seen or held.num_rows > HELD:
                    open_ = False
                    yield from held.to_batches()
                    held = None
        if pending:
            held = grouped([*([held] if held is not None else []), *pending])
        if held is not None:
            yield from held.to_batches()

    return rows.mapInArrow(run, rows.schema)


def finish(partial: DataFrame, keys: list[str], aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """The groups of partial rows."""
    return partial.groupBy(*keys).agg(*[getattr(F, DECOMPOSABLE[f][1])(n).alias(n) for n, (f, _) in aggs.items()])
