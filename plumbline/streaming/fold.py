"""The change log as a stream, folded into the newest entry of each key.

The fold keeps the largest sequence number of a key, so entries may come late, twice or in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators import changelog

#: Parts of the state, by a hash of the key; a micro-batch rewrites those that its keys are in.
PARTS = 64


def stream(spark: SparkSession, path: str, files_a_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(changelog.SCHEMA).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def folded(entries: DataFrame) -> DataFrame:
    """A streaming DataFrame of each key's newest entry; for output mode `update` or `complete`."""
    return changelog.newest(entries)


def start_fold(spark: SparkSession, source: str, target: str, checkpoint: str, keep: int = 8) -> StreamingQuery:
    """Folds what the source log holds into versions of a state under `target`, a version a micro-batch.

    A version holds the parts that the batch's keys are in, written from their last version and the batch,
    under the batch's number; one that is written again after a failure replaces itself. Parts that `keep`
    newer versions have replaced are deleted.
    """

    def merge(batch: DataFrame, number: int) -> None:
        part = F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int").alias("part")
        entries = batch.select("key", "seq", "op", "value", part).persist()
        touched = [r.part for r in entries.select("part").distinct().collect()]  # PARTS numbers at most
        old = _paths(spark, target, number - 1)
        for p in touched:
            if p in old:
                entries = entries.unionByName(spark.read.schema(changelog.SCHEMA).parquet(old[p]).withColumn("part", F.lit(p)))
        newest = entries.groupBy("part", "key").agg(F.max("seq").alias("seq"), F.max_by(F.struct("op", "value"), "seq").alias("e"))
        newest.select("part", "key", "seq", "e.op", "e.value").repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{target}/{number:09d}")
        _expire(spark, target, number - keep)

    return stream(spark, source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, target: str) -> tuple[object, list[tuple[int, int, object]]]:
    """The file system, and (version, part, path) of every part of every version whose writer has finished."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for version in fs.listStatus(path) if fs.exists(path) else []:
        names = {s.getPath().getName(): s.getPath() for s in fs.listStatus(version.getPath())}
        if "_SUCCESS" in names:
            found += [(int(version.getPath().getName()), int(n.partition("=")[2]), p) for n, p in names.items() if n.startswith("part=")]
    return fs, found


def _paths(spark: SparkSession, target: str, number: int) -> dict[int, str]:
    """Where the newest version of each part up to a number is."""
    return {part: str(path) for version, part, path in sorted(_versions(spark, target)[1], key=lambda x: x[0]) if version <= number}


def _expire(spark: SparkSession, target: str, number: int) -> None:
    """Deletes the parts of versions up to a number that a newer one up to that number has replaced."""
    fs, found = _versions(spark, target)
    newest = {part: version for version, part, _ in sorted(found, key=lambda x: x[0]) if version <= number}
    for version, part, path in found:
        if version < newest.get(part, -1):
            fs.delete(path, True)


def state_at(spark: SparkSession, target: str, number: int) -> DataFrame:
    """The newest entry of each key after a micro-batch; the last few can be read."""
    paths = _paths(spark, target, number)
    return spark.read.schema(changelog.SCHEMA).parquet(*paths.values()) if paths else changelog.empty(spark)
