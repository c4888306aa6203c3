"""Metrics of predictions, one distributed aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one(frame: DataFrame, value: Column) -> float:
    return frame.agg(value.alias("x")).first().x


def accuracy(frame: DataFrame, label: str, prediction: str, normalize: bool = True) -> float:
    same = (F.col(label) == F.col(prediction)).cast("double")
    return _one(frame, F.avg(same) if normalize else F.sum(same))


def mean_squared_error(frame: DataFrame, label: str, prediction: str, squared: bool = True) -> float:
    error = F.avg(F.pow(F.col(label) - F.col(prediction), 2))
    return _one(frame, error if squared else F.sqrt(error))


def r2(frame: DataFrame, label: str, prediction: str) -> float:
    y, p = F.col(label), F.col(prediction)
    return _one(frame, 1 - F.sum(F.pow(y - p, 2)) / (F.var_pop(y) * F.count(y)))


def log_loss(frame: DataFrame, label: str, probability: str, epsilon: float = 1e-15) -> float:
    """``probability``: of label 1."""
    p = F.least(F.greatest(F.col(probability), F.lit(epsilon)), F.lit(1 - epsilon))
    return _one(frame, -F.avg(F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p))))
