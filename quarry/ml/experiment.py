"""CREATE EXPERIMENT: search over parameters."""

from __future__ import annotations

import importlib
import itertools
import math
import random
from typing import Any

from pyspark.ml import Pipeline
from pyspark.ml import evaluation as E
from pyspark.ml.tuning import CrossValidator, TrainValidationSplit
from pyspark.sql import DataFrame, SparkSession

from quarry.ml.names import DRIVER_ROWS, NO_CLASS, PARAMETERS, in_driver, is_spark, make
from quarry.ml.train import stages

# Sentences that clients look for.
NO_MODEL = "Parameters must include a 'model_class' or 'automl_class' parameter."
NO_SEARCH = "Parameters must include a 'experiment_class' parameter for tuning {}."
NO_TARGET = "Unsupervised Algorithm cannot be tuned Automatically, a 'target_column' tells what to predict"

#: Names of searches: by folds, or by one split.
SEARCHES = {"GridSearchCV": CrossValidator, "RandomizedSearchCV": CrossValidator, "CrossValidator": CrossValidator, "TrainValidationSplit": TrainValidationSplit}


def drawn(values: list[list[Any]], n: int, random_: random.Random) -> list[tuple]:
    """``n`` different settings at random, all if there are no more."""
    count = math.prod(map(len, values))
    out = []
    for k in random_.sample(range(count), min(n, count)):
        choice = []
        for v in reversed(values):
            k, at = divmod(k, len(v))
            choice.append(list(v)[at])
        out.append(tuple(reversed(choice)))
    return out


def experiment(spark: SparkSession, options: dict[str, Any], frame: DataFrame) -> tuple[Any, list[str], DataFrame]:
    """The best model, its training columns, and a row for each setting that was tried."""
    options = dict(options)
    name, search, automl = options.pop("model_class", None), options.pop("experiment_class", None), options.pop("automl_class", None)
    target = options.pop("target_column", "") or None
    tune, more = dict(options.pop("tune_parameters", {}) or {}), dict(options.pop("experiment_kwargs", {}) or {})
    automl_options = dict(options.pop("automl_kwargs", {}) or {})
    options.pop("tune_fit_kwargs", None)
    if not target:
        raise ValueError(NO_TARGET)
    columns = [c for c in frame.columns if c != target]
    if automl:
        module, _, own = automl.rpartition(".")
        try:
            kind = getattr(importlib.import_module(module), own)
        except (ImportError, AttributeError, ValueError) as error:
            raise ValueError(NO_CLASS.format("automl model", automl)) from error
        found = kind(**automl_options)
        rows = in_driver(frame, int(more.get("driver_rows", DRIVER_ROWS)))
        found.fit(rows[columns], rows[target])
        tried = getattr(found, "evaluated_individuals_", {})
        results = [(str(k), str(v)) for k, v in tried.items()]
        return getattr(found, "fitted_pipeline_", found), columns, spark.createDataFrame(results, "models string, results string")
    if not name:
        raise ValueError(NO_MODEL)
    if not search:
        raise ValueError(NO_SEARCH.format(name))
    kind = SEARCHES.get(search.rpartition(".")[2])
    if kind is None:
        raise ValueError(NO_CLASS.format("tuner", search))
    estimator = make(name, options)
    if not is_spark(estimator):
        raise NotImplementedError("searches run on pyspark.ml estimators")
    frame = frame.withColumn(target, frame[target].cast("double"))
    own = {k: k if estimator.hasParam(k) else PARAMETERS.get(k, k) for k in tune}
    values = [v if isinstance(v, (list, tuple, set)) else [v] for v in tune.values()]
    if search.rpartition(".")[2] == "RandomizedSearchCV":
        choices = drawn(values, int(more.get("n_iter", 10)), random.Random(int(more.get("random_state", more.get("seed", 7)))))
    else:
        choices = itertools.product(*values)
    grid = [{estimator.getParam(own[k]): v for k, v in zip(tune, choice, strict=True)} for choice in choices]
    regression = "regression" in type(estimator).__module__
    evaluator = (E.RegressionEvaluator(labelCol=target, metricName="r2") if regression else E.MulticlassClassificationEvaluator(labelCol=target, metricName="accuracy"))
    pipeline = Pipeline(stages=stages(estimator, columns, target, frame))
    folds = {"numFolds": int(more.get("cv", more.get("numFolds", 3)))} if kind is CrossValidator else {"trainRatio": float(more.get("trainRatio", 0.75))}
    fitted = kind(estimator=pipeline, estimatorParamMaps=grid or [{}], evaluator=evaluator, seed=int(more.get("seed", 7)), **folds).fit(frame)
    scores = fitted.avgMetrics if kind is CrossValidator else fitted.validationMetrics
    order = sorted(range(len(scores)), key=lambda k: -scores[k])
    ranks = {k: int(1 + sum(scores[j] > scores[k] for j in order)) for k in order}
    rows = [(str({p.name: v for p, v in (grid or [{}])[k].items()}), float(scores[k]), ranks[k]) for k in range(len(scores))]
    return fitted.bestModel, columns, spark.createDataFrame(rows, "params string, mean_test_score double, rank_test_score int")
