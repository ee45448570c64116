"""Small helpers for columns and for lookups in dimension tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_of(array: Column) -> Column:
    """First element, or null for an empty or missing array."""
    return F.get(array, F.lit(0))


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """`fn(value)` with `value` computed once per row, however often `fn` uses it.

    Array functions are not compiled together with their surroundings, and the optimizer may
    copy a column's expression to every place that reads it.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def with_lookup(
    df: DataFrame, dim: DataFrame, key: str, value: str, default=None, out: str | None = None
) -> DataFrame:
    """Left join one value of a dimension, with a fallback for keys it lacks.

    No broadcast hint: the planner checks the size of `dim` and falls back to a
    shuffled join, which adaptive execution splits when one key is hot.
    """
    out = out or value
    picked = dim.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    hit = F.col("_value") if default is None else F.coalesce(F.col("_value"), F.lit(default))
    joined = df.join(picked, F.col(key) == F.col("_key"), "left")
    return joined.withColumn(out, hit).drop("_key", "_value")
