"""Aggregations in steps: chunks of the rows that a task gathers, combined within a task, then among tasks, then finished.

An aggregation has ``chunk`` and ``agg``, functions of a grouped series that give a series or
several, and maybe ``finalize``, a function of what ``agg`` gives.  ``agg`` takes
its own results again.  All three see many groups at once.  A group with many of the gathered rows costs
each task one row; rows of others go to the task that has their key, since a chunk of few
rows costs more than they do.  No worker ever holds a whole group.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows, and their bytes, that a task gathers before it reduces them.
HELD, HELD_BYTES = 1_000_000, 64 << 20
#: A group with at least so many of the gathered rows is reduced where they are read.
WORTH = 100


def in_steps(f: Any) -> bool:
    return all(hasattr(f, a) for a in ("chunk", "agg"))


def _parts(found: Any) -> tuple:
    return found if isinstance(found, tuple) else (found,)


def _codes(keys: list[pa.Array], n: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row's group, and the first row of each group; null is a value of its own."""
    codes = np.zeros(n, np.int64)
    for column in keys:
        own = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        _, codes = np.unique(codes * (own.max(initial=0) + 1) + own, return_inverse=True)
    _, first = np.unique(codes, return_index=True)
    return codes, first


def _unpacked(packed: list[bytes]) -> list[pd.Series]:
    return [pd.Series(list(part)) for part in zip(*map(pickle.loads, packed), strict=True)]


def _packed(keys: list[pa.Array], first: np.ndarray, found: list[list[pd.Series]]) -> list[pa.Array]:
    """The keys of each group, and for each aggregation what ``found`` has of it, in the order of the groups' numbers."""
    parts = [pa.array([pickle.dumps(v) for v in zip(*own, strict=True)], pa.binary()) for own in found]
    return [*(k.take(pa.array(first)) for k in keys), *parts]


def _sorted(found: Any) -> list[pd.Series]:
    return [p.sort_index() for p in _parts(found)]


def _full(held: list[pa.RecordBatch], most: int) -> bool:
    return sum(b.num_rows for b in held) >= most or sum(b.nbytes for b in held) >= HELD_BYTES


def _whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _combined(f: Any, packed: pa.Array, codes: np.ndarray, raw: list[pd.Series] | None = None) -> list[pd.Series]:
    """What ``agg`` makes of packed chunks, and of ``raw`` ones that have the groups' numbers as index."""
    parts = _unpacked(packed.to_pylist()) if len(packed) else []
    if raw is not None:
        codes = np.concatenate([codes, raw[0].index.to_numpy()])
        parts = [pd.concat(both, ignore_index=True) for both in zip(parts, raw, strict=True)] if parts else [r.reset_index(drop=True) for r in raw]
    return _sorted(f.agg(*[p.groupby(codes) for p in parts]))


def _finalized(f: Any, parts: list[pd.Series]) -> list:
    """The value of each group; a ``finalize`` that takes one group alone gets them one by one."""
    finalize = getattr(f, "finalize", None)
    if not finalize:
        return list(parts[0])
    try:
        found = finalize(*parts)
        if isinstance(found, pd.Series) and len(found) == len(parts[0]):
            return list(found.reindex(parts[0].index))
    except (TypeError, ValueError):
        pass
    found = [finalize(*(p.iloc[k : k + 1] for p in parts)) for k in range(len(parts[0]))]
    return [v.iloc[0] if isinstance(v, pd.Series) else v for v in found]


def aggregate(frame: DataFrame, keys: list[str], steps: dict[str, tuple[Any, str, str]], most: int = HELD) -> DataFrame:
    """``keys`` and a column for each of ``steps``: name -> (aggregation, column, Spark's type of the result); without keys one row.  A task gathers ``most`` rows."""
    names, n, m = list(steps), len(keys), len(steps)
    columns = [c for _, c, _ in steps.values()]
    functions = [f for f, _, _ in steps.values()]
    kinds = dict(frame.dtypes)
    # Spark's own grouping takes both zeros for one, so the keys have one of them.
    own = [F.when(F.col(k) == 0, F.lit(0).cast(kinds[k])).otherwise(F.col(k)).alias(k) if kinds[k] in ("double", "float") else F.col(k) for k in keys]
    frame = frame.select(*own, *[F.col(c).alias(f"_in_{k}") for k, c in enumerate(columns)])
    binary = [f"`_{k}` binary" for k in range(m)]
    rows_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema), *binary])
    keys_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema[:n]), *binary])
    worth = WORTH if keys else 0
    full = [*frame.columns, *(f"_{k}" for k in range(m))]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of groups with many rows, and the rows of others."""
        held: list[pa.RecordBatch] = []
        chunks: list[pa.RecordBatch] = []

        def packed(arrays: list[pa.Array], first: np.ndarray, found: list[list[pd.Series]], rows: pa.RecordBatch) -> pa.RecordBatch:
            out = _packed(arrays, first, found)
            return pa.RecordBatch.from_arrays([*out[:n], *(pa.nulls(len(first), rows.column(n + k).type) for k in range(m)), *out[n:]], names=full)

        def chunked() -> Iterator[pa.RecordBatch]:
            rows = _whole(held)
            held.clear()
            codes, _ = _codes(rows.columns[:n], rows.num_rows)
            many = np.bincount(codes)[codes] >= worth
            few = rows.filter(pa.array(~many))
            if few.num_rows:
                yield pa.RecordBatch.from_arrays([*few.columns, *(pa.nulls(few.num_rows, pa.binary()) for _ in range(m))], names=full)
            if many.any():
                rows = rows.filter(pa.array(many))
                _, first, codes = np.unique(codes[many], return_index=True, return_inverse=True)
                chunks.append(packed(rows.columns[:n], first, [_sorted(f.chunk(a.to_pandas().groupby(codes))) for f, a in zip(functions, rows.columns[n:], strict=True)], rows))
            if len(chunks) > 1 and _full(chunks, most // 10):
                yield from combined(most // 20)

        def combined(kept: int) -> Iterator[pa.RecordBatch]:
            """Combines the chunks; more than ``kept`` of them are passed on."""
            rows = _whole(chunks)
            chunks.clear()
            codes, first = _codes(rows.columns[:n], rows.num_rows)
            rows = packed(rows.columns[:n], first, [_combined(f, a, codes) for f, a in zip(functions, rows.columns[n + m :], strict=True)], rows)
            if rows.num_rows > kept or _full([rows], most):
                yield rows
            else:
                chunks.append(rows)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if _full(held, most):
                    yield from chunked()
        if held:
            yield from chunked()
        if chunks:
            yield from combined(0)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows and chunks, by key: values of the groups.  The last group may go on, so it stays behind as a chunk."""
        held: list[pa.RecordBatch] = []

        def settled(last: bool) -> Iterator[pa.RecordBatch]:
            rows = _whole(held)
            held.clear()
            codes, first = _codes(rows.columns[:n], rows.num_rows)
            chunk = rows.column(n + m).is_valid().to_numpy(zero_copy_only=False)
            raw, chunks = rows.filter(pa.array(~chunk)), rows.filter(pa.array(chunk))
            found = []
            for k, f in enumerate(functions):
                own = _sorted(f.chunk(raw.column(n + k).to_pandas().groupby(codes[~chunk]))) if raw.num_rows else None
                found.append(_combined(f, chunks.column(n + m + k), codes[chunk], own))
            done = np.arange(len(first)) != (-1 if last else codes[-1])
            if not last:
                open_ = _packed(rows.columns[:n], first[~done], [[p[~done] for p in parts] for parts in found])
                held.append(pa.RecordBatch.from_arrays([*open_[:n], *(pa.nulls(1, rows.column(n + k).type) for k in range(m)), *open_[n:]], names=full))
            if done.any():
                values = [pa.array([pickle.dumps(v) for v in _finalized(f, [p[done] for p in parts])], pa.binary()) for f, parts in zip(functions, found, strict=True)]
                yield pa.RecordBatch.from_arrays([*(k.take(pa.array(first[done])) for k in rows.columns[:n]), *values], names=[*keys, *(f"_{k}" for k in range(m))])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if _full(held, most) and len(held) > 1:
                    yield from settled(False)
        if held:
            yield from settled(True)

    chunks = frame.mapInArrow(spread, rows_schema)
    if not keys:
        gathered = chunks.agg(*[F.collect_list(f"_{k}").alias(f"_{k}") for k in range(m)])  # a row for each task
        return gathered.select(*[_finished(f, kind)(F.col(f"_{k}")).alias(name) for k, (name, (f, _, kind)) in enumerate(steps.items())])
    gathered = chunks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(gather, keys_schema)
    return gathered.select(*keys, *[_read(kind)(F.col(f"_{k}")).alias(name) for k, (name, (_, _, kind)) in enumerate(steps.items())])


def _read(kind: str):
    """Values as the type says; a pandas UDF knows how to make it of anything."""

    def own(packed: pd.Series) -> pd.Series:
        return pd.Series([pickle.loads(v) for v in packed])

    own.__annotations__ = {"packed": pd.Series, "return": pd.Series}
    return F.pandas_udf(own, kind)


def _finished(f: Any, kind: str):
    def own(packed: pd.Series) -> pd.Series:
        return pd.Series([_finalized(f, _combined(f, pa.array(list(rows), pa.binary()), np.zeros(len(rows), int)))[0] if len(rows) else None for rows in packed])

    own.__annotations__ = {"packed": pd.Series, "return": pd.Series}
    return F.pandas_udf(own, kind)
