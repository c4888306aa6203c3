"""From what a user has - frames, files, catalogs - to DataFrames."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quarry.plans.settings import overlay

#: Reader options that a format needs to be useful.
DEFAULTS = {"csv": {"header": "true", "inferSchema": "true"}}
#: Names of formats by file extension, where they differ.
EXTENSIONS = {"pq": "parquet", "parq": "parquet", "txt": "text", "jsonl": "json", "ndjson": "json", "tsv": "csv"}




def from_frame(spark: SparkSession, table: Any, format: str | None, **options: Any) -> DataFrame | None:
    return table if isinstance(table, DataFrame) else None


def from_pandas(spark: SparkSession, table: Any, format: str | None, npartitions: int | None = None, **options: Any) -> DataFrame | None:
    """Through Arrow, so that NaN becomes NULL; unsigned numbers are widened."""
    if hasattr(table, "to_pandas") and not isinstance(table, pd.DataFrame):
        table = table.to_pandas()
    if not isinstance(table, pd.DataFrame):
        return None
    wide = {"uint8": "Int16", "uint16": "Int32", "uint32": "Int64", "UInt8": "Int16", "UInt16": "Int32", "UInt32": "Int64"}
    table = table.astype({c: wide[str(k)] for c, k in table.dtypes.items() if str(k) in wide})
    table = table.reset_index(drop=True)
    table.columns = [str(c) for c in table.columns]
    with overlay(spark, {"spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.timestampType": "TIMESTAMP_NTZ"}):
        frame = spark.createDataFrame(table) if len(table.columns) else spark.createDataFrame([], T.StructType([]))
    return frame.repartition(npartitions) if npartitions and npartitions > 1 else frame


def from_catalog(spark: SparkSession, table: Any, format: str | None, hive_table_name: str | None = None, hive_schema_name: str = "default", table_name: str | None = None, **options: Any) -> DataFrame | None:
    """A table of the session's catalog: the metastore, or a temporary view that others published (format "memory")."""
    if format == "memory" and isinstance(table, str):
        return spark.table(table)
    if isinstance(table, str) and (format == "hive" or table.startswith(("hive://", "databricks+pyhive://"))):
        name = hive_table_name or table_name or table
        return spark.table(f"{hive_schema_name}.{name}" if "." not in name else name)
    return None


def from_intake(spark: SparkSession, table: Any, format: str | None, intake_table_name: str | None = None, catalog_kwargs: dict | None = None, **options: Any) -> DataFrame | None:
    """An entry of an intake catalog, if that package is installed."""
    is_catalog = type(table).__module__.partition(".")[0] == "intake"
    if not is_catalog and format != "intake" and not (isinstance(table, str) and table.endswith((".yaml", ".yml"))):
        return None
    if not is_catalog:
        import intake

        table = intake.open_catalog(table, **(catalog_kwargs or {}))
    entry = table[intake_table_name]
    return entry.to_spark() if hasattr(entry, "to_spark") else from_pandas(spark, entry.read(), None)


def from_location(spark: SparkSession, table: Any, format: str | None, schema: Any = None, **options: Any) -> DataFrame | None:
    """A path or URL that Spark reads; the format is given or told by the extension."""
    if not isinstance(table, (str, os.PathLike)):
        return None
    table = os.fspath(table)
    if not format:
        stem = table.rstrip("/").removesuffix("*").rstrip("/.")
        format = os.path.splitext(stem)[1].lstrip(".").lower()
        if format in ("gz", "bz2", "zst", "snappy"):
            format = os.path.splitext(os.path.splitext(stem)[0])[1].lstrip(".").lower()
    if not format:
        raise AttributeError(f"the format of {table} isn't known")
    tab = {"sep": "\t"} if format == "tsv" else {}
    format = EXTENSIONS.get(format, format)
    if format not in ("csv", "parquet", "json", "orc", "text", "avro", "xml", "jdbc", "binaryFile", "delta", "iceberg"):
        raise AttributeError(f"no reader for the format {format}")
    known = {**DEFAULTS.get(format, {}), **tab, **{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}}
    reader = spark.read.format(format).options(**known)
    return (reader.schema(schema) if schema else reader).load(table)


#: In the order in which they are asked; places for plugins are before the last.
HANDLERS: list[Callable[..., DataFrame | None]] = [from_frame, from_pandas, from_catalog, from_intake, from_location]


def to_frame(spark: SparkSession, table: Any, format: str | None = None, **options: Any) -> DataFrame:
    """``table`` as a DataFrame; a list of inputs is put one under another."""
    if isinstance(table, (list, tuple)):
        if not table:
            raise ValueError("an empty list of inputs")
        return reduce(DataFrame.unionAll, [to_frame(spark, t, format, **options) for t in table])
    for handler in HANDLERS:
        found = handler(spark, table, format, **options)
        if found is not None:
            return found
    raise ValueError(f"no input handler takes {type(table).__name__}")
