"""CREATE MODEL: fitting."""

from __future__ import annotations

from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame

from quarry.ml.names import DRIVER_ROWS, is_spark, make
from quarry.ml.wrappers import Incremental, ParallelPostFit, fit_whole


def stages(estimator: Any, columns: list[str], target: str | None, frame: DataFrame) -> list[Any]:
    """The estimator behind what brings the columns into one vector."""
    kinds = dict(frame.dtypes)
    texts = [c for c in columns if kinds[c] == "string"]
    out: list[Any] = [StringIndexer(inputCol=c, outputCol=f"_{c}_index", handleInvalid="keep") for c in texts]
    out.append(VectorAssembler(inputCols=[f"_{c}_index" if c in texts else c for c in columns], outputCol="_features", handleInvalid="skip"))
    for name, value in (("featuresCol", "_features"), ("inputCol", "_features"), ("labelCol", target)):
        if value and estimator.hasParam(name):
            estimator._set(**{name: value})
    if estimator.hasParam("outputCol"):
        estimator._set(outputCol="_output")
    return [*out, estimator]


def train(options: dict[str, Any], frame: DataFrame) -> tuple[Any, list[str]]:
    """The fitted model, and the columns that it was trained on."""
    options = dict(options)
    if "model_class" not in options:
        raise ValueError("model_class is missing: it names the model to fit")
    name, target = options.pop("model_class"), options.pop("target_column", "") or None
    wrap_predict, wrap_fit = bool(options.pop("wrap_predict", False)), bool(options.pop("wrap_fit", False))
    most = int(options.pop("driver_rows", DRIVER_ROWS))
    fit = options.pop("fit_kwargs", {}) or {}
    columns = [c for c in frame.columns if c != target]
    estimator = make(name, options)
    if is_spark(estimator):
        if target:
            kind = dict(frame.dtypes)[target]
            if kind != "double":
                frame = frame.withColumn(target, frame[target].cast("double"))
        return Pipeline(stages=stages(estimator, columns, target, frame)).fit(frame), columns
    if wrap_fit and hasattr(estimator, "partial_fit"):
        return Incremental(estimator).fit(frame, target, **fit), columns  # batch by batch
    fit_whole(estimator, frame, target, most, **fit)
    return (ParallelPostFit(estimator, columns) if wrap_predict else estimator), columns


def describe(model: Any) -> dict[str, Any]:
    if isinstance(model, PipelineModel):
        last = model.stages[-1]
        return {"model_class": type(last).__name__, **{p.name: v for p, v in last.extractParamMap().items()}}
    if is_spark(model):
        return {p.name: v for p, v in model.extractParamMap().items()}
    model = model.model if isinstance(model, ParallelPostFit) else model
    return {"model_class": type(model).__name__, **(model.get_params() if hasattr(model, "get_params") else vars(model))}
