"""The per-row confidence column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.predicates import VERACITY


def clamp(v: Column) -> Column:
    """A confidence as stored: a float in [0, 1]; null counts as full confidence."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v.cast("double"))), F.lit(1.0)).cast("float")


def attach(df: DataFrame, v: Column | float = 1.0) -> DataFrame:
    """`df` with its confidence column set, whatever it was before."""
    return df.withColumn(VERACITY, clamp(v if isinstance(v, Column) else F.lit(float(v))))


def visible(df: DataFrame) -> DataFrame:
    """The columns that `SELECT *` shows."""
    return df.drop(VERACITY)


def summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean of a value and the least confidence of each group, by partial and final hash aggregation."""
    return df.groupBy(by).agg(F.avg(value).alias(f"avg_{value}"), F.min(VERACITY).alias("min_veracity"))
