"""Text of a query's plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

MODES = ("simple", "extended", "codegen", "cost", "formatted")


def plan_text(frame: DataFrame, mode: str = "formatted") -> str:
    if mode not in MODES:
        raise ValueError(f"no plan in mode {mode}")
    execution = frame._jdf.queryExecution()
    return frame.sparkSession._jvm.PythonSQLUtils.explainString(execution, mode)


def pushed_filters(frame: DataFrame) -> list[str]:
    """The filters that reach the readers."""
    return [line.split("PushedFilters:", 1)[1].strip() for line in plan_text(frame).splitlines() if "PushedFilters:" in line]


def shuffles(frame: DataFrame) -> int:
    """Exchanges in the plan before it is adapted."""
    return sum("Exchange" in line and "(" in line for line in plan_text(frame, "simple").splitlines() if "Reused" not in line)
