"""Schemas and what is registered in them."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

DEFAULT_SCHEMA = "root"
CATALOG = "quarry"


@dataclass
class Function:
    """Overloads of one name: ``(parameter types, Spark name)``."""

    aggregate: bool
    overloads: dict[tuple[str, ...], str] = field(default_factory=dict)
    f: Any = None
    row: bool = False
    returns: Any = None


@dataclass
class Table:
    frame: DataFrame
    view: str
    rows: float | None = None
    path: str | None = None


@dataclass
class Schema:
    name: str
    tables: dict[str, Table] = field(default_factory=dict)
    functions: dict[str, Function] = field(default_factory=dict)
    models: dict[str, tuple[Any, list[str]]] = field(default_factory=dict)
    experiments: dict[str, DataFrame] = field(default_factory=dict)
