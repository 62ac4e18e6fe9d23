"""Sessions: settings the engine expects, and the package's own code on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

#: Settings for a session made here; a session that exists already keeps its own.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session in this process, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    spark = builder.config(map=SETTINGS | {"spark.sql.shuffle.partitions": str(partitions)}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def kept(df: DataFrame) -> DataFrame:
    """The same rows with the lineage cut, in the folder that driver and executors share (`spark.checkpoint.dir`)."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:  # only a session without the setting, as in a local test, gets a folder of its own
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="plumbline-checkpoint-"))
    return df.checkpoint()


#: Rows and bytes of a batch on its way to a Python worker. Documents are long, and a batch is held
#: on both sides at once, so Spark's 10 000 rows would take much of a worker's memory.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in Python workers, wherever they run (once an application), and bounds their batches."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="plumbline-")) / "plumbline.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)
    return spark
