"""Comparisons and logic over columns.

The default is SQL's three-valued logic. `two_valued=True` gives comparisons that are never null: null
equals null, differs from every value, and sorts before every value. `strict_types=True` keeps values of
different types apart, decided when the plan is built: they are never equal, and the order of their types
decides which is less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import similarity

#: Order of the types when values of different types are compared strictly.
TYPE_ORDER = (T.NullType, T.BooleanType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.TimestampType)

EQUAL, NOT_EQUAL, LESS, LESS_EQUAL, GREATER, GREATER_EQUAL = "=", "<>", "<", "<=", ">", ">="
VERACITY = "__veracity__"
VERACITY_TOLERANCE = 1e-4


def _ordinal(kind: T.DataType) -> int:
    return next((k for k, t in enumerate(TYPE_ORDER) if isinstance(kind, t)), len(TYPE_ORDER))


def compare(left: Column, op: str, right: Column, *, two_valued: bool = False, strict_types: tuple[T.DataType, T.DataType] | None = None) -> Column:
    if strict_types and _ordinal(strict_types[0]) != _ordinal(strict_types[1]):
        less = _ordinal(strict_types[0]) < _ordinal(strict_types[1])
        return F.lit({EQUAL: False, NOT_EQUAL: True, LESS: less, LESS_EQUAL: less, GREATER: not less, GREATER_EQUAL: not less}[op])
    if two_valued:
        equal = left.eqNullSafe(right)
        less = F.coalesce(left < right, left.isNull() & right.isNotNull())
        return {EQUAL: equal, NOT_EQUAL: ~equal, LESS: less, LESS_EQUAL: less | equal, GREATER: ~(less | equal), GREATER_EQUAL: ~less}[op]
    return {EQUAL: left == right, NOT_EQUAL: left != right, LESS: left < right, LESS_EQUAL: left <= right, GREATER: left > right, GREATER_EQUAL: left >= right}[op]


def all_of(*parts: Column) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def any_of(*parts: Column) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def where(df: DataFrame, predicate: Column | None) -> DataFrame:
    """Rows for which the predicate is true; all rows without one."""
    return df if predicate is None else df.where(predicate)


def column(df: DataFrame, ref: int | str) -> Column:
    """A column by position or name; an unknown one raises IndexError or KeyError."""
    if isinstance(ref, int):
        return df[df.columns[ref]]
    if ref not in df.columns:
        raise KeyError(ref)
    return df[ref]


def fuzzy_like(c: Column, pattern: str, threshold: float = similarity.THRESHOLD, algorithm: str = "jaro_winkler") -> Column:
    return similarity.is_similar(c, F.lit(pattern), threshold, algorithm)


def veracity(op: str, threshold: float, c: Column | None = None) -> Column:
    """Comparison of a row's veracity, as a double, with a threshold; = and <> within VERACITY_TOLERANCE."""
    v, t = (F.col(VERACITY) if c is None else c).cast("double"), F.lit(float(threshold))
    if op in (EQUAL, NOT_EQUAL):
        near = F.abs(v - t) < VERACITY_TOLERANCE
        return near if op == EQUAL else ~near
    return compare(v, op, t)
