"""Models of other libraries over DataFrames: fitted on the driver or batch by batch, applied in parallel."""

from __future__ import annotations

from collections.abc import Iterator
from inspect import signature
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.ml.names import DRIVER_ROWS, in_driver, result_type


def fit_whole(model: Any, frame: DataFrame, target: str | None, most: int, **options: Any) -> None:
    """Fits on every row: in the driver at once, or, of more than ``most`` rows, batch by batch if the model has ``partial_fit``."""
    if hasattr(model, "partial_fit") and frame.limit(most + 1).count() > most:
        Incremental(model).fit(frame, target, **options)
        return
    rows = in_driver(frame, most)
    model.fit(rows[[c for c in frame.columns if c != target]], *([rows[target]] if target else []), **options)


def in_batches(frame: DataFrame, size: int) -> Iterator[pd.DataFrame]:
    """The rows, ``size`` at a time; they come partition by partition as Arrow bytes."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema) as stream:
                stream.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["rows"])

    held: list[pa.RecordBatch] = []
    for row in frame.mapInArrow(packed, "rows binary").toLocalIterator(prefetchPartitions=True):
        held += pa.ipc.open_stream(row.rows)
        if sum(b.num_rows for b in held) >= size:
            table = pa.Table.from_batches(held)
            whole = table.num_rows - table.num_rows % size
            for k in range(0, whole, size):
                yield table.slice(k, size).to_pandas()
            held = table.slice(whole).to_batches()
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).to_pandas()


class ParallelPostFit:
    """A model whose ``predict``, ``predict_proba``, ``predict_log_proba`` and ``transform`` run on the executors."""

    def __init__(self, model: Any, columns: list[str] | None = None):
        self.model, self.columns = model, columns

    def fit(self, frame: DataFrame, target: str | None = None, **options: Any) -> ParallelPostFit:
        self.columns = [c for c in frame.columns if c != target]
        fit_whole(self.model, frame, target, int(options.pop("driver_rows", DRIVER_ROWS)), **options)
        return self

    def _apply(self, frame: DataFrame, method: str) -> DataFrame:
        columns = self.columns or frame.columns
        call = getattr(self.model, method)
        sample = frame.select(*columns).limit(1).toPandas()
        kind = result_type(self.model, call(sample) if len(sample) else np.zeros(1))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                found = np.asarray(call(rows[columns]))
                yield rows.assign(**{method: list(found)})

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
        return frame.mapInPandas(run, f"{schema}, `{method}` {kind}")

    def predict(self, frame: DataFrame) -> DataFrame:
        return self._apply(frame, "predict")

    def predict_proba(self, frame: DataFrame) -> DataFrame:
        return self._apply(frame, "predict_proba")

    def predict_log_proba(self, frame: DataFrame) -> DataFrame:
        return self._apply(frame, "predict_log_proba")

    def transform(self, frame: DataFrame) -> DataFrame:
        return self._apply(frame, "transform")

    def score(self, frame: DataFrame, target: str, metric: str = "r2") -> float:
        from quarry.ml import metrics

        return getattr(metrics, metric)(self.predict(frame), target, "predict")


class Incremental(ParallelPostFit):
    """A model with ``partial_fit``, fitted on one batch after another; the driver holds one partition at a time."""

    def fit(self, frame: DataFrame, target: str | None = None, batch_size: int = 10_000, **options: Any) -> Incremental:
        self.columns = [c for c in frame.columns if c != target]
        if target and "classes" not in options and "classes" in signature(self.model.partial_fit).parameters:
            options["classes"] = np.sort(frame.select(target).distinct().toPandas()[target].to_numpy())  # the first batch may lack some
        for rows in in_batches(frame, batch_size):
            self.model.partial_fit(rows[self.columns], *([rows[target]] if target else []), **options)
        return self

    partial_fit = fit
