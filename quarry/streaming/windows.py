"""Windowed aggregation that is the same for a table and for a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(frame: DataFrame, time: str, width: str, keys: list[str], aggregates: dict[str, Column], *, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """``start, end``, keys and aggregates of each window; of a stream, rows later than ``late`` are left out."""
    if frame.isStreaming:
        frame = frame.withWatermark(time, late)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    grouped = frame.groupBy(window.alias("_window"), *keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return grouped.select(F.col("_window.start").alias("start"), F.col("_window.end").alias("end"), *keys, *aggregates)


def register_stream(engine, name: str, path: str, schema: str, format: str = "parquet", **options) -> None:
    """A stream of files as a table of the engine; queries on it give streaming frames."""
    engine.register(name, engine.spark.readStream.format(format).schema(schema).options(**options).load(path))
