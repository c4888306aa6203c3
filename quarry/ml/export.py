"""EXPORT MODEL."""

from __future__ import annotations

import pickle
from typing import Any

from quarry.ml.names import is_spark


def export(model: Any, format: str = "pickle", location: str = "tmp.pkl", **options: Any) -> None:
    """``pyspark.ml`` models save themselves, wherever Spark can write; others are pickled."""
    format = format.lower().strip()
    if format == "onnx":
        raise NotImplementedError("ONNX export")
    if format in ("spark", "mleap") or is_spark(model) and format in ("pickle", "pkl", "joblib"):
        model.write().overwrite().save(location)
    elif format in ("pickle", "pkl"):
        with open(location, "wb") as file:
            pickle.dump(model, file, **options)
    elif format == "joblib":
        import joblib

        joblib.dump(model, location, **options)
    elif format == "mlflow":
        import mlflow

        (mlflow.spark if is_spark(model) else mlflow.sklearn).save_model(model, location, **options)
    else:
        raise NotImplementedError(f"the format {format}")
