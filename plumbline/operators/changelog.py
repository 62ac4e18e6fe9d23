"""The key-value side: an append-only log of (key, seq, op, value) and the states it describes.

A key's state at a sequence number is its entry with the largest seq up to there; a tombstone there means
that the key is absent. Every state is one aggregation by key, which combines before it shuffles, so a
key with very many versions costs a row a task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PUT, DELETE = "PUT", "DELETE"
SCHEMA = "key string, seq bigint, op string, value string"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def as_of(log: DataFrame, seq: int | Column | None = None, ts: Column | None = None, ts_column: str = "ts") -> DataFrame:
    """The log up to a sequence number (None or 0: all of it), or up to a time in `ts_column`."""
    if ts is not None:
        return log.where(F.col(ts_column) <= ts)
    if seq is None or (isinstance(seq, int) and seq == 0):
        return log
    return log.where(F.col("seq") <= seq)


def newest(log: DataFrame) -> DataFrame:
    """(key, seq, op, value): the newest entry of each key, tombstones included."""
    return log.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by(F.struct("op", "value"), "seq").alias("_e")).select("key", "seq", "_e.op", "_e.value")


def state(log: DataFrame, seq: int | Column | None = None) -> DataFrame:
    """(key, value, seq) of the keys that are present."""
    return newest(as_of(log, seq)).where(F.col("op") == PUT).select("key", "value", "seq")


def get(log: DataFrame, key: str, seq: int | None = None) -> DataFrame:
    """The state of one key; the key's filter reaches the scan. No row if it is absent."""
    return state(log.where(F.col("key") == key), seq)


def visibility(log: DataFrame) -> DataFrame:
    return newest(log).select("key", (F.col("op") == PUT).alias("live"))


def exists(log: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, found) for each distinct probed key; only those keys' entries are folded."""
    wanted = probes.select("key").distinct()
    found = state(log.join(wanted, "key", "left_semi")).select("key", F.lit(True).alias("found"))
    return wanted.join(found, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"))


def snapshot_seq(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("snapshot_seq"))


def appended(spark: SparkSession, operations: Iterable[tuple[str, str, str | None]], after: int) -> DataFrame:
    """Entries for (op, key, value) in order, numbered from `after` + 1. One writer numbers at a time."""
    rows = [(key, after + n, op, value if op == PUT else None) for n, (op, key, value) in enumerate(operations, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def batch(log: DataFrame, operations: DataFrame) -> DataFrame:
    """Entries for a table (n, op, key, value) of operations, numbered by n after the log's last entry.

    A batch is what one writer sends at once, so one task numbers it.
    """
    number = F.row_number().over(Window.orderBy("n"))
    last = F.broadcast(log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_last")))
    return operations.crossJoin(last).select("key", (F.col("_last") + number).alias("seq"), "op", F.when(F.col("op") == PUT, F.col("value")).alias("value"))


def range_scan(log: DataFrame, low: str | None = None, high: str | None = None, reverse: bool = False) -> DataFrame:
    """(key, value) of present keys in [low, high), in byte order of the keys, ascending or descending."""
    if low is not None:
        log = log.where(F.col("key") >= low)
    if high is not None:
        log = log.where(F.col("key") < high)
    return state(log).select("key", "value").orderBy(F.desc("key") if reverse else F.asc("key"))


def versions(log: DataFrame) -> DataFrame:
    """All entries, key ascending, newest first within a key."""
    return log.select("key", "seq", "op", "value").orderBy(F.asc("key"), F.desc("seq"))


def version_rank(log: DataFrame) -> DataFrame:
    return log.select("key", "seq", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq"))).alias("rn"))


def stats(log: DataFrame) -> DataFrame:
    """Counts over the log: one row, folded from one row a key."""
    per_key = log.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("op") == PUT).cast("long")).alias("puts"), F.max_by("op", "seq").alias("op")
    )
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_versions"),
        F.count(F.lit(1)).alias("num_keys"),
        F.coalesce(F.sum((F.col("op") == PUT).cast("long")), F.lit(0)).alias("live_keys"),
        F.coalesce(F.sum("puts"), F.lit(0)).alias("writes"),
        F.coalesce(F.sum(F.col("n") - F.col("puts")), F.lit(0)).alias("deletes"),
    )


def retained(log: DataFrame, min_seq: int) -> DataFrame:
    return log.where(F.col("seq") >= min_seq).select("key", "seq", "op", "value")


def dump(log: DataFrame) -> DataFrame:
    """Entries as a log inspector prints them."""
    put = F.col("op") == PUT
    return log.select("seq", F.when(put, "PUT").otherwise("DEL").alias("type"), "key", F.when(put, F.col("value")).otherwise("<deleted>").alias("val"))


def compacted(log: DataFrame, horizon: int | None = None) -> DataFrame:
    """The log without entries that no read at or after `horizon` (None: the head) can see.

    Newer entries all stay; of those up to the horizon, each key keeps its newest, unless that is a
    tombstone, which says nothing more once older entries are gone.
    """
    if horizon is None:
        return newest(log).where(F.col("op") == PUT).select("key", "seq", "op", "value")
    old = newest(log.where(F.col("seq") <= horizon)).where(F.col("op") == PUT)
    return old.select("key", "seq", "op", "value").unionByName(log.where(F.col("seq") > horizon).select("key", "seq", "op", "value"))
