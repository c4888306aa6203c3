"""The JSON of the wire protocol."""

from __future__ import annotations

import datetime
import decimal
import math
from typing import Any

from pyspark.sql import types as T

# Spark's types and the protocol's names.
NAMES = {"string": "varchar", "int": "integer", "bigint": "bigint", "smallint": "smallint", "tinyint": "tinyint", "boolean": "boolean", "double": "double", "float": "real", "date": "date", "timestamp": "timestamp with time zone", "timestamp_ntz": "timestamp", "binary": "varbinary", "void": "unknown"}


def column(field: T.StructField) -> dict[str, Any]:
    kind = field.dataType.simpleString()
    name = "decimal" if kind.startswith("decimal") else NAMES.get(kind, "varchar")
    arguments = [{"kind": "LONG", "value": v} for v in (field.dataType.precision, field.dataType.scale)] if isinstance(field.dataType, T.DecimalType) else []
    return {"name": field.name, "type": name, "typeSignature": {"rawType": name, "arguments": arguments}}


def cell(value: Any) -> Any:
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else ("+Infinity" if value > 0 else "-Infinity") if math.isinf(value) else value
    if isinstance(value, (datetime.datetime, datetime.date, datetime.time, datetime.timedelta, decimal.Decimal)):
        return str(value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, dict):
        return {str(k): cell(v) for k, v in value.items()}
    return [cell(v) for v in value] if isinstance(value, (list, tuple)) else str(value)


def stats(state: str, rows: int = 0) -> dict[str, Any]:
    numbers = ("nodes", "totalSplits", "queuedSplits", "runningSplits", "completedSplits", "cpuTimeMillis", "wallTimeMillis", "queuedTimeMillis", "elapsedTimeMillis", "processedBytes", "peakMemoryBytes")
    return {"state": state, "queued": state == "QUEUED", "scheduled": state != "QUEUED", **dict.fromkeys(numbers, 0), "processedRows": rows}


def answer(query: str, base: str, state: str, schema: T.StructType | None = None, rows: list | None = None, pending: bool = False) -> dict[str, Any]:
    out: dict[str, Any] = {"id": query, "infoUri": base, "stats": stats(state, len(rows or []))}
    if pending:
        out |= {"nextUri": f"{base}/v1/status/{query}", "partialCancelUri": f"{base}/v1/cancel/{query}"}
    if schema is not None:
        out |= {"columns": [column(f) for f in schema], "data": [[cell(v) for v in r] for r in rows or []]}
    return out


def failure(query: str, base: str, error: BaseException) -> dict[str, Any]:
    message = str(error)
    return {"id": query, "infoUri": base, "stats": stats("FAILED"), "error": {"message": message, "errorCode": 0, "errorName": type(error).__name__, "errorType": "USER_ERROR", "errorLocation": {"lineNumber": 1, "columnNumber": 1}}}
