"""Queries over the driver's tables, one or more per operator family.

A query is SQL of the engine's dialect, or a function of an engine; DuckDB
gets the same text where it reads it alike, else its own.  Whole tables are read.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "flagship"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
MODULES = ("relational", "joins", "aggregates", "windows", "ordering", "scalars", "statements", "frames")

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracle: dict[str, str] = {}


def engine_for(spark: SparkSession, sf_dir: str, text: str | None = None):
    """An engine that has the tables which ``text`` names (all without one)."""
    from quarry.engine import Engine

    engine = Engine(spark)
    words = set(re.findall(r"\w+", text.lower())) if text is not None else set(TABLES)
    for name in TABLES:
        if name in words:
            engine.create_table(name, f"{sf_dir}/{name}.parquet", format="parquet")
    return engine


def add(name: str, sql: str, oracle: str | None = "") -> None:
    """``oracle``: DuckDB's text; empty: the same; None: SQL can't tell."""
    _queries[name] = lambda spark, sf_dir: engine_for(spark, sf_dir, sql).sql(sql)
    if oracle is not None:
        _oracle[name] = oracle or sql


def query(oracle: str | None = None, tables: str | None = None) -> Callable:
    """Register a function of an engine under its name."""

    def register(f: Callable[[Any], DataFrame]) -> Callable:
        _queries[f.__name__] = lambda spark, sf_dir: f(engine_for(spark, sf_dir, tables))
        if oracle:
            _oracle[f.__name__] = oracle
        return f

    return register


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"quarry.operators.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracle)
