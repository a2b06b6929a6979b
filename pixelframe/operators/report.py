"""Ratios of measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def speedup(times: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The rows with `speedup`, the first value of their series (by `order`) divided by their own; null for zero."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return times.withColumn("speedup", F.when(F.col(value) != 0, F.first(value).over(w) / F.col(value)))
