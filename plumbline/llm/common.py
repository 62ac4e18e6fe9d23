"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import ship

#: Resolution of the hash that `bounded_sample` thins rows by.
_SLICES = 1 << 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in `sf_dir`; also sees to it that Python workers can import this package."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, text: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, in order, of up to `most` bytes in its column number `text`, or of one row."""
    length = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(text)])
    low = 0
    while low < batch.num_rows:
        room = most + (int(length[low - 1]) if low else 0)
        high = max(low + 1, int(np.searchsorted(length, room, side="right")))
        yield batch.slice(low, high - low)
        low = high


def release() -> None:
    """Gives back memory that this process no longer uses: Python workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 3; fold 1 is held out of every fit. A row without an id is of fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir` as the session has it.

    Only a session without one (a local test) gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="plumbline-checkpoint-"))
    return sc.getCheckpointDir()


def deleted(spark: SparkSession, path: str) -> None:
    """Removes a folder of intermediate files that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def swept(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files of plans that nothing holds any more.

    Its cleaner goes by the driver's garbage collection, which a large step may end long before.
    """
    gc.collect()  # Python's handles of plans
    spark.sparkContext._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows with the lineage cut, kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def repeatable(df: DataFrame) -> DataFrame:
    """The same rows, such that a task that runs again reads the same ones in the same order.

    A scan of files does; rows that come out of a shuffle may not, so they are written first.
    """
    return checkpointed(df) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def mapped(docs: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *added: T.StructField) -> DataFrame:
    """`docs` after `work` on its Arrow batches, which appends the columns `added`; names of columns may be any.

    `work` sees the columns under numbers, as Spark would read a name with a dot as a field of another column.
    """
    plain = docs.toDF(*(f"_{k}" for k in range(len(docs.columns))))
    schema = T.StructType([*plain.schema.fields, *(T.StructField(f"_{f.name}", f.dataType) for f in added)])
    return plain.mapInArrow(work, schema).toDF(*docs.columns, *(f.name for f in added))


def extended(batch: pa.RecordBatch, *columns: pa.Array) -> pa.RecordBatch:
    """A batch with more columns, for `mapped`."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *(f"+{k}" for k in range(len(columns)))])


def bounded_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most `n` rows of `df`, chosen by a hash of `keys`, so the same rows each time.

    All rows come back if there are no more than `n`. One count decides the sampling rate; the rate
    aims 5 % below `n` so that the closing limit has nothing to cut in practice.
    """
    total = df.count()
    if total > n:
        bar = int(_SLICES * 0.95 * n / total)
        df = df.where(F.pmod(F.xxhash64(*keys), F.lit(_SLICES)) < bar)
    return df.limit(n)
