"""PREDICT: the columns of the query and ``target``."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.ml.names import is_spark, result_type
from quarry.ml.wrappers import ParallelPostFit


def predict(model: Any, columns: list[str], frame: DataFrame) -> DataFrame:
    kept = [c for c in frame.columns if c != "target"]
    if is_spark(model):
        out = model.transform(frame.select(*kept))
        found = "prediction" if "prediction" in out.columns else "_output"
        value = vector_to_array(F.col(found)) if found == "_output" else F.col(found)
        return out.select(*kept, value.alias("target"))
    model = model.model if isinstance(model, ParallelPostFit) else model  # predictions are always made in parallel
    sample = frame.select(*columns).limit(1).toPandas()
    kind = result_type(model, model.predict(sample)) if len(sample) else "double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(target=model.predict(rows[columns]))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*kept).schema)
    return frame.select(*kept).mapInPandas(run, f"{schema}, target {kind}")
