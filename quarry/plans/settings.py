"""Options of the engine and the Spark settings that they stand for.

They come, the later before the earlier, from the file that ``QUARRY_CONFIG`` names (YAML, or JSON where no YAML
reader is installed; nested keys are joined by points), from the environment (``QUARRY__SQL__JOIN__BROADCAST=false``), from the engine, and from the statement.
"""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import SparkSession


def _broadcast(value: Any) -> dict[str, str]:
    """True or a number: how readily small sides are broadcast; False: never; None: Spark's threshold."""
    if value is None:
        return {}
    if value is False:
        return {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    factor = 1.0 if value is True else float(value)
    return {"spark.sql.autoBroadcastJoinThreshold": str(int(factor * 20 * 1024 * 1024))}


#: Option -> settings for a value.
OPTIONS = {
    "sql.join.broadcast": _broadcast,
    "sql.aggregate.split_out": lambda v: {"spark.sql.shuffle.partitions": str(int(v))},
    "sql.identifier.case_sensitive": lambda v: {"spark.sql.caseSensitive": str(bool(v)).lower()},
    "sql.predicate_pushdown": lambda v: {"spark.sql.parquet.filterPushdown": str(bool(v)).lower(), "spark.sql.orc.filterPushdown": str(bool(v)).lower()},
    "sql.dynamic_partition_pruning": lambda v: {"spark.sql.optimizer.dynamicPartitionPruning.enabled": str(bool(v)).lower()},
    "sql.optimizer.join_reorder": lambda v: {k: str(bool(v)).lower() for k in ("spark.sql.cbo.enabled", "spark.sql.cbo.joinReorder.enabled", "spark.sql.cbo.starSchemaDetection")},
}
#: Options of other engines that have no meaning here; accepted and ignored.
IGNORED = ("sql.aggregate.split_every", "sql.limit.check-first-partition", "sql.optimize", "sql.optimizer.verbose", "sql.optimizer.fact_dimension_ratio", "sql.optimizer.max_fact_tables", "sql.optimizer.preserve_user_order", "sql.optimizer.filter_selectivity", "sql.sort.topk-nelem-limit", "sql.mappings.decimal_support")


def _flat(value: Any, before: str = "") -> dict[str, Any]:
    if not isinstance(value, dict):
        return {before: value}
    out: dict[str, Any] = {}
    for k, v in value.items():
        out |= _flat(v, f"{before}.{k}" if before else str(k))
    return out


def _known(name: str) -> str:
    """An option as it is written here, whatever its case and whether it has hyphens or underscores."""
    plain = lambda x: x.lower().replace("-", "_")
    return next((k for k in (*OPTIONS, *IGNORED) if plain(k) == plain(name)), name)


def defaults() -> dict[str, Any]:
    """Options of the file and of the environment."""
    out: dict[str, Any] = {}
    if path := os.environ.get("QUARRY_CONFIG"):
        with open(path, encoding="utf-8") as file:
            text = file.read()
        try:
            import yaml

            read = yaml.safe_load(text)
        except ImportError:
            read = json.loads(text)
        out |= {_known(k.removeprefix("quarry.")): v for k, v in _flat(read or {}).items()}
    for key, value in os.environ.items():
        if key.startswith("QUARRY__"):
            try:
                value = json.loads(value.lower() if value in ("True", "False", "None") else value)
            except ValueError:
                pass
            out[_known(key.removeprefix("QUARRY__").replace("__", ".").lower())] = value
    return out


def settings(options: dict[str, Any]) -> dict[str, str]:
    out: dict[str, str] = {}
    for key, value in options.items():
        key = key.removeprefix("quarry.")
        if key in OPTIONS:
            out |= OPTIONS[key](value)
        elif key.startswith("spark."):
            out[key] = str(value)
        elif key in IGNORED:
            warnings.warn(f"the option {key} has no meaning here: Spark decides", stacklevel=3)
        else:
            raise KeyError(f"no option {key}")
    return out


@contextmanager
def overlay(spark: SparkSession, options: dict[str, Any] | None) -> Iterator[None]:
    """Settings for a while, for what happens at analysis; a frame's settings when it runs are those of its session by then."""
    wanted = settings(options or {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
