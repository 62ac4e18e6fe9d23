"""The change log as folders of Parquet files, one set of files a batch of entries, a folder a generation.

Appends go to the newest generation whose writer has finished; a flush or a compaction writes the next one.
Every entry carries a checksum, which is compared whenever its value is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.errors import AlreadyExists, Corruption, NotFound
from plumbline.operators import changelog

_CHECKED = f"{changelog.SCHEMA}, crc bigint"


def checksum() -> Column:
    """CRC-32 of an entry; no value and an empty one differ."""
    value = F.coalesce(F.concat(F.lit("="), F.col("value")), F.lit("-"))
    return F.crc32(F.concat_ws("\x1f", F.coalesce("key", F.lit("")), F.col("seq").cast("string"), F.coalesce("op", F.lit("")), value).cast("binary"))


class Log:
    """A log under a folder; one writer appends, anyone reads."""

    def __init__(self, spark: SparkSession, path: str, create_if_missing: bool = True, error_if_exists: bool = False) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        if there and error_if_exists:
            raise AlreadyExists(f"log exists: {path}")
        if not there:
            if not create_if_missing:
                raise NotFound(f"log not found: {path}")
            self._stored(changelog.empty(spark)).write.parquet(self.path)

    def _stored(self, entries: DataFrame) -> DataFrame:
        return entries.select("key", "seq", "op", "value", checksum().alias("crc"))

    def _files(self) -> DataFrame:
        return self.spark.read.schema(_CHECKED).parquet(self.path)

    def _sound(self) -> Column:
        return F.col("crc").isNull() | (F.col("crc") == checksum())

    def read(self) -> DataFrame:
        """All entries; a query that reads the value of an entry whose checksum does not fit fails. Entries without one are taken as they are.

        The check hangs on the value and is no filter: Spark may put a constant that another filter names in
        the place of a column, before it drops the rows that differ from it.
        """
        bad = F.raise_error(F.concat(F.lit("corrupt log entry at "), F.coalesce(F.col("seq").cast("string"), F.lit("an unknown place")))).cast("string")
        return self._files().select("key", "seq", "op", F.when(self._sound(), F.col("value")).otherwise(bad).alias("value"))

    def corrupt(self) -> DataFrame:
        """(key, seq, op, value) of the entries whose checksum does not fit."""
        return self._files().where(~self._sound()).select("key", "seq", "op", "value")

    def verify(self) -> None:
        if (n := self.corrupt().count()) > 0:
            raise Corruption(f"{n} corrupt entries in {self.path}")

    def last_seq(self) -> int:
        return self._files().agg(F.max("seq")).first()[0] or 0

    def append(self, entries: DataFrame) -> None:
        self._stored(entries).write.mode("append").parquet(self.path)

    def rewrite(self, entries: DataFrame, to: str) -> Log:
        """A log at another place with these entries, by key within files: what a flush or a compaction leaves.

        Reading by key then skips row groups by their statistics and bloom filters.
        """
        rows = self._stored(entries).repartitionByRange("key").sortWithinPartitions("key", F.desc("seq"))
        rows.write.option("parquet.bloom.filter.enabled#key", "true").parquet(to)
        return Log(self.spark, to)


class Generations:
    """The logs under one folder, by number, and the first sequence number that was never given out."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        path = self._path(self.base)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _numbers(self, finished: bool) -> list[int]:
        found = [int(n) for n in self._names() if n.isdigit()]
        return sorted(n for n in found if not finished or self._fs.exists(self._path(f"{self.base}/{n:06d}/_SUCCESS")))

    def open(self, create_if_missing: bool = True, error_if_exists: bool = False) -> tuple[Log, int]:
        """The newest log whose writer has finished, and the next sequence number."""
        done = self._numbers(finished=True)
        log = Log(self.spark, f"{self.base}/{done[-1] if done else 0:06d}", create_if_missing, error_if_exists)
        marks = [int(n.partition("-")[2]) for n in self._names() if n.startswith("_next-")]
        return log, max([log.last_seq() + 1, *marks])

    def rewrite(self, log: Log, entries: DataFrame, next_seq: int) -> Log:
        """The next generation, with these entries of `log`. Numbers before `next_seq` stay taken, whatever the entries are."""
        self._fs.create(self._path(f"{self.base}/_next-{next_seq}"), True).close()
        number = self._numbers(finished=False)[-1] + 1
        new = log.rewrite(entries, f"{self.base}/{number:06d}")
        for old in self._numbers(finished=False):  # the one before stays, for those who read it now
            if f"{self.base}/{old:06d}" not in (log.path, new.path):
                self._fs.delete(self._path(f"{self.base}/{old:06d}"), True)
        for mark in self._names():
            if mark.startswith("_next-") and int(mark.partition("-")[2]) < next_seq:
                self._fs.delete(self._path(f"{self.base}/{mark}"), False)
        return new
