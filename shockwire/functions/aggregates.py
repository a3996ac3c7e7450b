"""Aggregates that stay null where Spark's own would divide by zero."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def pearson(x: str, y: str, over: WindowSpec | None = None) -> Column:
    """Pearson's r of two columns, null where either is constant; as an aggregate, or over a window."""
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    both, a, b = (p.over(over) for p in parts) if over is not None else parts
    return F.when(a * b > 0, F.try_divide(both, a * b))
