"""Short names of model classes."""

from __future__ import annotations

import importlib
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Fixed value: a sentence that clients look for.
NO_CLASS = "Can not import {} {}. Make sure you spelled it correctly and have installed all packages."
# Names that other libraries use, and the estimator of ``pyspark.ml`` that does the same.
CLASSES = {
    "LinearRegression": "regression.LinearRegression", "Ridge": "regression.LinearRegression", "Lasso": "regression.LinearRegression", "GeneralizedLinearRegression": "regression.GeneralizedLinearRegression",
    "DecisionTreeRegressor": "regression.DecisionTreeRegressor", "RandomForestRegressor": "regression.RandomForestRegressor", "GradientBoostingRegressor": "regression.GBTRegressor", "GBTRegressor": "regression.GBTRegressor", "IsotonicRegression": "regression.IsotonicRegression", "AFTSurvivalRegression": "regression.AFTSurvivalRegression", "FMRegressor": "regression.FMRegressor",
    "LogisticRegression": "classification.LogisticRegression", "DecisionTreeClassifier": "classification.DecisionTreeClassifier", "RandomForestClassifier": "classification.RandomForestClassifier", "GradientBoostingClassifier": "classification.GBTClassifier", "GBTClassifier": "classification.GBTClassifier", "LinearSVC": "classification.LinearSVC", "GaussianNB": "classification.NaiveBayes", "MultinomialNB": "classification.NaiveBayes", "NaiveBayes": "classification.NaiveBayes", "MLPClassifier": "classification.MultilayerPerceptronClassifier", "FMClassifier": "classification.FMClassifier",
    "KMeans": "clustering.KMeans", "BisectingKMeans": "clustering.BisectingKMeans", "GaussianMixture": "clustering.GaussianMixture", "LDA": "clustering.LDA",
    "PCA": "feature.PCA", "StandardScaler": "feature.StandardScaler", "MinMaxScaler": "feature.MinMaxScaler",
}
# Parameters of other libraries and what they are called here; None: no meaning here.
PARAMETERS = {"n_estimators": "numTrees", "max_depth": "maxDepth", "n_clusters": "k", "n_components": "k", "max_iter": "maxIter", "random_state": "seed", "alpha": "regParam", "learning_rate": "stepSize", "tol": "tol", "fit_intercept": "fitIntercept", "n_jobs": None}


def find_class(name: str) -> type:
    """A short name, a full path to a class, or NotImplementedError."""
    if name in CLASSES:
        name = "pyspark.ml." + CLASSES[name]
    if "." not in name:
        raise ValueError(f"no model class {name}")
    module, _, own = name.rpartition(".")
    for place in (name, f"pyspark.ml.{name}"):
        module, _, own = place.rpartition(".")
        try:
            return getattr(importlib.import_module(module), own)
        except (ImportError, AttributeError):
            continue
    raise ValueError(NO_CLASS.format("model", name))


def make(name: str, parameters: dict[str, Any]) -> Any:
    """An estimator; of a class of ``pyspark.ml`` parameters go by either name."""
    kind = find_class(name)
    if not kind.__module__.startswith("pyspark.ml"):
        return kind(**parameters)
    out = kind()
    for key, value in parameters.items():
        own = key if out.hasParam(key) else PARAMETERS.get(key, key)
        if own == "numTrees" and not out.hasParam(own):
            own = "maxIter"
        if own is None:
            continue
        if not out.hasParam(own):
            raise TypeError(f"{name} has no parameter {key}")
        out = out._set(**{own: value})
    return out


def is_spark(model: Any) -> bool:
    return type(model).__module__.startswith("pyspark.ml")


#: Rows that a model of another library may be fitted on in the driver, unless the statement says ``driver_rows``.
DRIVER_ROWS = 1_000_000


def in_driver(frame: DataFrame, most: int = DRIVER_ROWS) -> pd.DataFrame:
    """A bounded table; ValueError if there is more of it."""
    rows = frame.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a model that is fitted in the driver: give wrap_fit for one that has partial_fit, a sample, or another driver_rows")
    return rows


def result_type(model: Any, found: Any) -> str:
    """The type of what a model gives: labels as they are, numbers as double, whatever the first of them is like."""
    first = np.asarray(found)
    labels = getattr(model, "classes_", None)
    if first.dtype == object or first.dtype.kind in "US":
        kind = "string"
    elif first.dtype.kind == "b":
        kind = "boolean"
    elif first.dtype.kind in "iu" and labels is not None and np.asarray(labels).dtype.kind in "iu":
        kind = "bigint"
    else:
        kind = "double"
    return f"array<{kind}>" if first.ndim > 1 else kind
