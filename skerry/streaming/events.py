"""Event-time helpers for Structured Streaming; each also works on a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, at: str, width: str, keys: list[str], *aggregates: Column, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding windows by key; ``late`` sets a watermark, which bounds the state of a stream."""
    source = df.withWatermark(at, late) if late else df
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return source.groupBy(window.alias("w"), *keys).agg(*aggregates).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *[c for c in _names(aggregates)])


def sessions(df: DataFrame, at: str, gap: str, keys: list[str], *aggregates: Column, late: str | None = None) -> DataFrame:
    source = df.withWatermark(at, late) if late else df
    return source.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(*aggregates).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *[c for c in _names(aggregates)])


def _names(columns: tuple[Column, ...]) -> list[str]:
    return [c._jc.toString().rsplit(" AS ", 1)[1].strip("`") for c in columns]
