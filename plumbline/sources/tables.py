"""Tables as versioned Parquet folders.

A table is a folder of numbered versions. An insert adds files to the newest version; a delete writes the
rows that stay to the next one, so nothing is overwritten while it is read, and a version counts only once
its writer has finished. Folders may lie in any store that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.errors import AlreadyExists, InvalidArgument, NotFound
from plumbline.operators import veracity
from plumbline.operators.predicates import VERACITY


class Tables:
    """Tables and index descriptions under one folder; both are there again for whoever opens it later."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _inside(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def names(self) -> list[str]:
        return [n for n in self._inside(self.root) if not n.startswith("_")]

    @property
    def indexes(self) -> dict[str, tuple[str, str]]:
        """(table, column) by index: each is a file of these two lines under `_indexes`."""
        read = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString
        out = {}
        for name in self._inside(f"{self.root}/_indexes"):
            if not name.startswith("."):
                stream = self._fs.open(self._path(f"{self.root}/_indexes/{name}"))
                table, column = read(stream, "UTF-8").split("\n")
                stream.close()
                out[name] = (table, column)
        return out

    def exists(self, name: str) -> bool:
        return self._version(name) >= 0

    def _version(self, name: str) -> int:
        folder = self._path(f"{self.root}/{name}")
        if not self._fs.exists(folder):
            return -1
        done = [int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit() and self._fs.exists(self._path(f"{s.getPath()}/_SUCCESS"))]
        return max(done, default=-1)

    def _folder(self, name: str, ahead: int = 0) -> str:
        version = self._version(name)
        if version < 0:
            raise NotFound(f"table not found: {name}")
        return f"{self.root}/{name}/{version + ahead:06d}"

    def create(self, name: str, schema: str | T.StructType) -> DataFrame:
        """A new table without rows, with the confidence column last. Raises AlreadyExists."""
        if self.exists(name):
            raise AlreadyExists(f"table exists: {name}")
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        kind = T.StructType([f for f in kind.fields if f.name != VERACITY] + [T.StructField(VERACITY, T.FloatType())])
        plain = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, (T.VarcharType, T.CharType)) else f.dataType) for f in kind])
        self.spark.createDataFrame([], plain).write.parquet(f"{self.root}/{name}/{0:06d}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        """All columns of a table, the confidence column included."""
        return self.spark.read.parquet(self._folder(name))

    def schema(self, name: str) -> T.StructType:
        return self.read(name).schema

    def drop(self, name: str) -> bool:
        """Whether there was such a table; its indexes go with it."""
        if not self.exists(name):
            return False
        for index, (table, _) in self.indexes.items():
            if table == name:
                self.drop_index(index)
        return bool(self._fs.delete(self._path(f"{self.root}/{name}"), True))

    def insert(self, name: str, rows: DataFrame, columns: tuple[str, ...] = (), v: Column | float = 1.0) -> int:
        """Appends rows by position (to `columns`, others null) with one confidence for all; returns how many.

        A confidence column among `rows` is not used. Values are cast as Spark stores them: one that does
        not fit its column's type raises.
        """
        schema = self.schema(name)
        rows = rows.drop(VERACITY)
        targets = list(columns) or [f.name for f in schema if f.name != VERACITY]
        if len(rows.columns) != len(targets):
            raise InvalidArgument(f"{len(targets)} values expected, {len(rows.columns)} given")
        if unknown := set(targets) - set(schema.names):
            raise InvalidArgument(f"no such column: {', '.join(sorted(unknown))}")
        rows = rows.toDF(*targets)
        stored = [(F.col(f"`{f.name}`").cast(f.dataType) if f.name in targets else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema if f.name != VERACITY]
        before = self.read(name).count()  # both counts come from file footers
        veracity.attach(rows.select(*stored), v).write.mode("append").parquet(self._folder(name))
        return self.read(name).count() - before

    def delete(self, name: str, predicate: Column | str | None = None) -> None:
        """Removes the rows for which the predicate is true (all without one)."""
        rows = self.read(name)
        if predicate is None:
            stay = rows.where(F.lit(False))
        else:
            gone = F.expr(predicate) if isinstance(predicate, str) else predicate
            stay = rows.where(~F.coalesce(gone, F.lit(False)))
        stay.write.parquet(self._folder(name, ahead=1))

    def create_index(self, index: str, name: str, column: str) -> None:
        """Describes an index. Parquet statistics do the skipping; `cluster_by` lays the files out for it."""
        if index in self.indexes:
            raise AlreadyExists(f"index exists: {index}")
        if column not in self.schema(name).names:
            raise InvalidArgument(f"no such column: {column}")
        stream = self._fs.create(self._path(f"{self.root}/_indexes/{index}"), False)
        stream.write(bytearray(f"{name}\n{column}".encode()))
        stream.close()

    def drop_index(self, index: str) -> bool:
        return bool(self._fs.delete(self._path(f"{self.root}/_indexes/{index}"), False))

    def cluster_by(self, index: str) -> None:
        """Rewrites a table in the order of an index's column, so that row groups can be skipped by it."""
        if (found := self.indexes.get(index)) is None:
            raise NotFound(f"index not found: {index}")
        name, column = found
        self.read(name).repartitionByRange(column).sortWithinPartitions(column).write.parquet(self._folder(name, ahead=1))
