"""From raw documents to packed training windows: five stages, each read from the last one's Parquet files."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import common, jaccard, mixing, packing, pii, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject; it is fitted on `labels` and the raw documents.

    A null or empty text is scored as one without features, rows of equal id each for itself.
    """
    model = toxicity.fit_frames(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingle similarity, the one of the smallest id; documents without words all stay."""
    common.ship(spark)
    return jaccard.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, personal data in their texts replaced by its kind; null texts stay null."""
    common.ship(spark)
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents in the order of the mix of their sources; a null source is a source of its own."""
    return mixing.mix(docs)


def in_file_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, place) of `docs`, just read from Parquet files: place numbers the rows in the order of parts and rows in them."""
    of = docs.metadataColumn("_metadata")
    rows = docs.select("doc_id", "text", of["file_path"].alias("file"), of["row_index"].alias("row"))
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))  # a row a file
    number = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).try_cast("long")
    before = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(offsets), "file").select("doc_id", "text", (F.col("before") + F.col("row")).alias("place"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows that follow the mix: the mixing stage's rows tell it by their order in its files. A null text is an empty one."""
    common.ship(spark)
    return packing.pack(in_file_order(docs), place="place")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: The classifiers and the tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the whole of `documents` in `sf_dir`.

    Each stage's rows are written as Parquet to the folder that driver and executors share, and read
    again, so a lost executor costs no more than the stage at hand; a stage's files go once the next one's
    are written.
    """
    docs = common.table(spark, sf_dir, "documents")
    folder = posixpath.join(common.shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    done = None
    for name, stage in STAGES:
        path = posixpath.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if done:
            common.deleted(spark, done)
        done = path
    return docs
