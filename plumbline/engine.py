"""One object for all of it: tables and SQL with fuzzy predicates and confidence, the key-value log, procedures."""

from __future__ import annotations

import contextlib
import shlex
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.errors import EngineError, InvalidArgument, NotFound, NotSupported
from plumbline.functions import scalars, similarity
from plumbline.operators import changelog, veracity
from plumbline.operators.predicates import VERACITY
from plumbline.plans import dialect
from plumbline.session import ship
from plumbline.sources.logs import Generations
from plumbline.sources.tables import Tables


class Engine:
    """Reads return DataFrames; a key that is absent gives no row. One engine writes a log at a time.

    What was written is there again for the next engine on the same folder, flushed, compacted or not.
    """

    def __init__(self, spark: SparkSession, path: str, create_if_missing: bool = True, error_if_exists: bool = False, enable_python: bool = True) -> None:
        self.spark, self.enable_python = ship(spark), enable_python
        self.tables = Tables(spark, f"{path}/tables")
        self._generations = Generations(spark, f"{path}/log")
        self.log, self._next = self._generations.open(create_if_missing, error_if_exists)
        self.procedures: dict[str, Callable] = {}
        similarity.register(spark)

    # ---- tables

    def sql(self, text: str) -> DataFrame:
        """Runs a statement of the dialect; `SELECT *` of a table hides the confidence column."""
        plan = dialect.parse(text)
        if isinstance(plan, dialect.Create):
            return self.tables.create(plan.table, plan.columns)
        if isinstance(plan, dialect.Insert):
            with self._views():
                rows = self.spark.sql(plan.query)
            n = self.tables.insert(plan.table, rows, plan.columns, 1.0 if plan.veracity is None else plan.veracity)
            return self.spark.createDataFrame([(n,)], "inserted bigint")
        if isinstance(plan, dialect.Delete):
            before = self.tables.read(plan.table).count()
            self.tables.delete(plan.table, plan.predicate)
            return self.spark.createDataFrame([(before - self.tables.read(plan.table).count(),)], "deleted bigint")
        with self._views():
            out = self.spark.sql(plan)
        star = any(t.text == "*" for t in dialect.tokens(plan)) and VERACITY.upper() not in {t.word() for t in dialect.tokens(plan)[: self._from(plan)]}
        return veracity.visible(out) if star else out

    @staticmethod
    def _from(text: str) -> int:
        toks = dialect.tokens(text)
        return next((k for k, t in enumerate(toks) if t.word() == "FROM"), len(toks))

    @contextlib.contextmanager
    def _views(self) -> Iterator[None]:
        """The tables under their names, while a statement is analysed."""
        names = [n for n in self.tables.names() if self.tables.exists(n)]
        for name in names:
            self.tables.read(name).createOrReplaceTempView(name)
        try:
            yield
        finally:
            for name in names:
                self.spark.catalog.dropTempView(name)

    # ---- key-value log

    def put(self, key: str, value: str) -> int:
        return self.write([(changelog.PUT, key, value)])

    def delete(self, key: str) -> int:
        return self.write([(changelog.DELETE, key, None)])

    def write(self, operations: Iterable[tuple[str, str, str | None]]) -> int:
        """Appends (op, key, value) entries as one batch; returns the last sequence number."""
        entries = changelog.appended(self.spark, operations, self._next - 1)
        last = entries.agg(F.max("seq")).first()[0]
        if last is not None:
            self.log.append(entries)
            self._next = last + 1
        return self._next - 1

    def get(self, key: str, seq: int | None = None, field: str | None = None) -> DataFrame:
        found = changelog.get(self.log.read(), key, seq)
        return found if field is None else found.select("key", scalars.field(F.col("value"), field).alias("value"), "seq").where("value IS NOT NULL")

    def exists(self, key: str) -> bool:
        return not self.get(key).isEmpty()

    def scan(self, low: str | None = None, high: str | None = None, reverse: bool = False) -> DataFrame:
        return changelog.range_scan(self.log.read(), low, high, reverse)

    def snapshot(self) -> int:
        return self._next - 1

    def stats(self) -> DataFrame:
        return changelog.stats(self.log.read())

    def compact(self, horizon: int | None = None) -> None:
        """Rewrites the log without entries that reads at or after `horizon` cannot see."""
        self.log = self._generations.rewrite(self.log, changelog.compacted(self.log.read(), horizon), self._next)

    # ---- procedures and commands

    def register(self, name: str, procedure: Callable) -> None:
        self.procedures[name] = procedure

    def call(self, name: str, **arguments):
        """Runs a registered procedure with this engine as its first argument; scripts as text are not run.

        What the procedure raises comes back as InvalidArgument with its text.
        """
        if not self.enable_python:
            raise NotSupported("procedures are switched off")
        if name not in self.procedures:
            raise NotFound(f"procedure not found: {name}")
        try:
            return self.procedures[name](self, **arguments)
        except EngineError:
            raise
        except Exception as e:
            raise InvalidArgument(f"{name}: {type(e).__name__}: {e}") from e

    def reset(self) -> None:
        """Forgets all registered procedures."""
        self.procedures.clear()

    def execute(self, command: str) -> DataFrame | str | int:
        """A command line: GET k [field | AS OF n | n], PUT/SET k v, DEL/DELETE k, EXISTS k, PING, STATUS/INFO, FLUSH, COMPACT, EXEC name."""
        words = shlex.split(command)
        verb, rest = (words[0].upper(), words[1:]) if words else ("", [])
        if verb == "GET" and rest:
            if [w.upper() for w in rest[1:3]] == ["AS", "OF"] and len(rest) == 4:
                return self.get(rest[0], int(rest[3]))
            if len(rest) == 1:
                return self.get(rest[0])
            return self.get(rest[0], int(rest[1])) if rest[1].isdigit() else self.get(rest[0], field=rest[1])
        if verb in ("PUT", "SET") and len(rest) >= 2:
            return self.put(rest[0], " ".join(rest[1:]))
        if verb in ("DEL", "DELETE") and len(rest) == 1:
            return self.delete(rest[0])
        if verb == "EXISTS" and len(rest) == 1:
            return int(self.exists(rest[0]))
        if verb == "PING":
            return "PONG"
        if verb in ("STATUS", "INFO"):
            return self.stats()
        if verb in ("FLUSH", "COMPACT"):
            self.compact(0 if verb == "FLUSH" else None)
            return "OK"
        if verb in ("EXEC", "PYTHON") and rest:
            return self.call(rest[0])
        if verb in ("SELECT", "INSERT", "CREATE", "DELETE", "WITH"):
            return self.sql(command)
        raise InvalidArgument(f"unknown command: {command}")
