"""Plan rewrites that callers apply by choice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_distinct_value(df: DataFrame, column: str, name: str, build: Callable[[Column], Column]) -> DataFrame:
    """`df` with `build(column)` as a column, computed once for each distinct value.

    For an expensive expression over a column of few values. The values come from an aggregate that
    combines before it shuffles; the join back is null-safe and left to the optimizer, which broadcasts
    the values only if statistics at run time show that they are small.
    """
    values = df.select(F.col(column).alias("_value")).distinct()
    scored = values.select("_value", build(F.col("_value")).alias(name))
    return df.join(scored, F.col(column).eqNullSafe(F.col("_value")), "left").drop("_value")
