"""Python functions as Spark functions: Arrow batches, never row by row unless the function asks for rows."""

from __future__ import annotations

import datetime
import decimal
import itertools
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Python, numpy and SQL names of types, and Spark's.
TYPES = {
    int: "bigint", float: "double", str: "string", bool: "boolean", bytes: "binary", decimal.Decimal: "decimal(38,10)", datetime.date: "date", datetime.datetime: "timestamp_ntz", datetime.timedelta: "interval day to second",
    "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "float32": "float", "float64": "double", "bool": "boolean", "boolean": "boolean",
    "string": "string", "str": "string", "object": "string", "datetime64[ns]": "timestamp_ntz", "datetime64[us]": "timestamp_ntz", "timedelta64[ns]": "interval day to second",
    "tinyint": "tinyint", "smallint": "smallint", "integer": "int", "int": "int", "bigint": "bigint", "float": "float", "double": "double", "varchar": "string", "date": "date", "timestamp": "timestamp_ntz",
}


def type_name(kind: Any) -> str:
    """Spark's name of a type given in any usual way; NotImplementedError if there is none."""
    if isinstance(kind, T.DataType):
        return kind.simpleString()
    if isinstance(kind, str):
        name = kind.lower()
    elif kind in TYPES:
        return TYPES[kind]
    else:
        try:
            name = str(pd.api.types.pandas_dtype(kind)).lower()
        except TypeError as error:
            raise NotImplementedError(f"the type {kind!r}") from error
    if name in TYPES:
        return TYPES[name]
    raise NotImplementedError(f"the type {kind!r}")


def _series(result: Any, like: pd.Series) -> pd.Series:
    return result if isinstance(result, pd.Series) else pd.Series(result, index=like.index) if isinstance(result, (list, np.ndarray)) else pd.Series([result] * len(like), index=like.index)


def scalar_udf(f: Callable, names: list[str], returns: str):
    def own(*columns: pd.Series) -> pd.Series:
        return _series(f(*columns), columns[0])

    own.__annotations__ = {"columns": pd.Series, "return": pd.Series}
    return pandas_udf(own, returns)


class Row(dict):
    """A row by name: ``row["a"]`` or ``row.a``; far cheaper than a Series."""

    __getattr__ = dict.__getitem__


def row_udf(f: Callable, names: list[str], returns: str):
    """``f(row, *values)``: the row has the columns by name; values that are alike throughout a batch come behind it, if ``f`` takes them."""
    import inspect

    positional = [p for p in inspect.signature(f).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]
    extra = len(positional) - 1

    def own(*columns: pd.Series) -> pd.Series:
        first = len(columns) - extra if extra > 0 else len(columns)
        own_names = names[:first]
        rows = (Row(zip(own_names, values, strict=False)) for values in zip(*columns[:first], strict=True))
        more = zip(*columns[first:], strict=True) if first < len(columns) else itertools.repeat(())
        return pd.Series([f(row, *values) for row, values in zip(rows, more)], index=columns[0].index)

    own.__annotations__ = {"columns": pd.Series, "return": pd.Series}
    return pandas_udf(own, returns)


def grouped_udf(f: Any, names: list[str], returns: str):
    steps = all(hasattr(f, a) for a in ("chunk", "agg"))

    def whole(column: pd.Series) -> Any:
        if not steps:
            return f(column)
        one = lambda s: s.groupby(np.zeros(len(s), int))
        parts = f.chunk(one(column))
        parts = parts if isinstance(parts, tuple) else (parts,)
        parts = f.agg(*[one(p) for p in parts])
        parts = parts if isinstance(parts, tuple) else (parts,)
        finalize = getattr(f, "finalize", None)
        out = finalize(*parts) if finalize else parts[0]
        return out.iloc[0] if isinstance(out, pd.Series) else out

    def own(column: pd.Series) -> Any:
        return whole(column)

    own.__annotations__ = {"column": pd.Series, "return": {"double": float, "float": float, "string": str, "boolean": bool}.get(returns, int)}
    return pandas_udf(own, returns)
