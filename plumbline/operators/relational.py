"""Scans, lookups, projections and set operations of the relational side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import kept


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Rows with that key: an equality that reaches the Parquet scan. None is a missing key."""
    return df.where(F.col(key) == F.lit(value)) if value is not None else df.where(F.lit(False))


def index_range(df: DataFrame, key: str, low=None, high=None, ordered: bool = True) -> DataFrame:
    """Rows from the first key >= low and before `high`, ascending by key; either end may be open."""
    if low is not None:
        df = df.where(F.col(key) >= F.lit(low))
    if high is not None:
        df = df.where(F.col(key) < F.lit(high))
    return df.orderBy(F.col(key).asc()) if ordered else df


def unique_by(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One row a key, the first in `order`: what an index that refuses a second row of a key keeps.

    The rows to keep are found by a partial and a final aggregate, so a frequent key is no one task's.
    """
    whole = F.struct(*(F.col(c) for c in df.columns))
    return df.groupBy(key).agg(F.min_by(whole, order).alias("_row")).select("_row.*")


def prefix_scan(df: DataFrame, key: str, prefix: str) -> DataFrame:
    return df.where(F.col(key).startswith(prefix))


def overlaps(low1: Column, high1: Column, low2: Column, high2: Column) -> Column:
    """Closed ranges that share a point."""
    return ~((high1 < low2) | (low1 > high2))


def merge_runs(*runs: DataFrame, order: list[str]) -> DataFrame:
    """Rows of all sorted runs in one order, repeated keys kept."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.orderBy(*order)


def positions(df: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    """Rows numbered from 1 in an order: sorted by ranges, numbered in each and moved up by the rows of the ranges before.

    The sorted rows are kept in the shared folder, as their numbers need them to stay where they are.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the range's number, and from bit 33 down the row's in it
    rows = kept(placed.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.shiftright(at, 33).alias("range"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = rows.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(offsets), "range").select("row.*", (F.col("offset") + F.col("nth") + 1).alias(name))
