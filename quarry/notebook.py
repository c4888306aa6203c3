"""``%sql`` and ``%%sql`` in notebooks."""

from __future__ import annotations

import time
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def run_cell(engine, text: str, scope: dict[str, Any], auto_include: bool = False, out=print) -> Any:
    """The statement with ``{name}`` filled from ``scope``; with ``auto_include`` frames of the scope are tables."""
    frames = {k: v for k, v in scope.items() if auto_include and not k.startswith("_") and isinstance(v, (DataFrame, pd.DataFrame))}
    began = time.time()
    result = engine.sql(text.format(**scope) if "{" in text else text, dataframes=frames)
    result = result.toPandas() if isinstance(result, DataFrame) else result
    out(f"took {time.time() - began:.3f} s")
    return result


def register(engine, auto_include: bool = False) -> None:
    """Make the magic known to the running notebook; an ImportError without IPython."""
    from IPython import get_ipython
    from IPython.core.magic import register_line_cell_magic

    def sql(line: str, cell: str | None = None) -> Any:
        return run_cell(engine, line if cell is None else cell, get_ipython().user_ns, auto_include)

    register_line_cell_magic(sql)
