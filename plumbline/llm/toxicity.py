"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct hashed character n-grams of its lower-cased text. Each is
scaled by the log ratio of its smoothed frequencies among toxic and clean training documents, those
that tell little either way are left out, the vector is brought to unit length, and a logistic regression
over those scaled features gives the score. Texts are read whole, in the fit as well; the fit alone works
on a bounded sample of labelled rows, whose features are found on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import bounded_sample, extended, fold_of, mapped, release, table

NGRAMS = (4, 5, 6)
BITS = 20
#: Bounds of the sample that a model is fitted on: rows of either class.
MAX_TOXIC, MAX_CLEAN = 2000, 5000
#: A feature counts if this many training documents have it, and its log ratio is this far from 0.
MIN_DOCUMENTS, MIN_RATIO = 5, 2.0
EPOCHS, BATCH, RATE, RIDGE = 25, 128, 0.02, 1e-6
THRESHOLD = 0.7

_MULTIPLY, _ADD, _SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1), np.uint32(2654435761)


def _grams(text: str | None) -> np.ndarray:
    """Feature numbers of a text's n-grams, repeated ones too; a text without an n-gram has none."""
    points = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    found, rolling = [np.zeros(0, np.uint32)], points
    for n in range(2, NGRAMS[-1] + 1):
        if len(points) < n:
            break
        rolling = rolling[:-1] * _MULTIPLY + points[n - 1 :] * _ADD
        if n in NGRAMS:
            found.append(((rolling + np.uint32(n)) * _SPREAD) >> np.uint32(32 - BITS))
    return np.concatenate(found)


def packed(text: str | None) -> bytes:
    """The distinct features of a text as compressed bits: never more than 2**BITS of them, however long the text."""
    bits = np.zeros(1 << BITS, bool)
    bits[_grams(text)] = True
    return zstandard.compress(np.packbits(bits).tobytes(), 3)


def unpacked(data: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(zstandard.decompress(data), np.uint8)))


@dataclass
class ToxicityModel:
    """feature: the features that count, ascending; ratio: their scales; weight: their coefficients times the scale."""

    feature: np.ndarray
    ratio: np.ndarray
    weight: np.ndarray
    bias: float

    @cached_property
    def _at(self) -> np.ndarray:
        """Place of each feature number among those that count, -1 for the others."""
        out = np.full(1 << BITS, -1, np.int32)
        out[self.feature] = np.arange(len(self.feature))
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_at"}

    def score(self, text: str | None) -> float:
        at = self._at[_grams(text)]
        at = np.unique(at[at >= 0])
        r = self.ratio[at]
        length = float(np.sqrt(np.dot(r, r)))
        z = self.bias + (float(self.weight[at].sum()) / length if length > 0 else 0.0)
        return float(1.0 / (1.0 + np.exp(-min(50.0, max(-50.0, z)))))


def fit(texts: list[str | None], toxic: list[int]) -> ToxicityModel:
    return fit_packed([packed(t) for t in texts], toxic)


def fit_packed(rows: list[bytes], toxic: list[int]) -> ToxicityModel:
    """A model from the packed features of rows and their labels.

    Rows of the rarer class weigh more, by the root of the classes' ratio. Without rows of both classes the
    model scores every text with the share of toxic rows (0 for no rows).
    """
    size = 1 << BITS
    y = np.asarray(toxic, dtype=np.float64)
    count = {1: np.zeros(size), 0: np.zeros(size)}
    for row, label in zip(rows, toxic):
        count[int(label)][unpacked(row)] += 1
    if not 0 < y.sum() < len(y):
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.float32), 50.0 if len(y) and y.all() else -50.0)
    every = np.log((count[1] + 1) / (y.sum() + 2)) - np.log((count[0] + 1) / ((1 - y).sum() + 2))
    feature = np.flatnonzero((count[0] + count[1] >= MIN_DOCUMENTS) & (np.abs(every) >= MIN_RATIO))
    ratio, at = every[feature], np.full(size, -1)
    at[feature] = np.arange(len(feature))
    docs = [(f := at[unpacked(row)])[f >= 0].astype(np.int32) for row in rows]
    norm = [1.0 / max(1e-9, float(np.sqrt(np.dot(ratio[f], ratio[f])))) for f in docs]
    heavy = np.where(y == 1, np.sqrt(max(1.0, (1 - y).sum() / y.sum())), np.sqrt(max(1.0, y.sum() / (1 - y).sum())))

    # Adam over mini-batches; only one batch's features are ever laid out together
    w, bias, first, second, step = np.zeros(len(feature)), 0.0, np.zeros(len(feature)), np.zeros(len(feature)), 0
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        shuffled = order.permutation(len(docs))
        for low in range(0, len(docs), BATCH):
            some = shuffled[low : low + BATCH]
            flat = np.concatenate([docs[k] for k in some])
            owner = np.repeat(np.arange(len(some)), [len(docs[k]) for k in some])
            value = ratio[flat] * np.asarray([norm[k] for k in some])[owner]
            z = bias + np.bincount(owner, weights=w[flat] * value, minlength=len(some))
            miss = (1.0 / (1.0 + np.exp(-np.clip(z, -50, 50))) - y[some]) * heavy[some]
            slope = np.bincount(flat, weights=miss[owner] * value, minlength=len(feature)) / len(some) + RIDGE * w
            step += 1
            first += 0.1 * (slope - first)
            second += 0.01 * (slope * slope - second)
            w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
            bias -= 0.1 * float(miss.mean())
    return ToxicityModel(feature, ratio.astype(np.float32), (w * ratio).astype(np.float32), bias)


def fit_frames(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """A model from `labels` (doc_id, toxic) outside the held-out fold and the texts in `docs`.

    Labels are thinned to at most MAX_TOXIC and MAX_CLEAN rows by a hash of the id before they meet
    the texts, so what is broadcast has a fixed bound and the documents are scanned once. Null labels and
    null ids are left out; an id that is labelled more than once counts once, as toxic if any of its rows
    says so, and of documents of one id the smallest text counts.
    """
    usable = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(fold_of(F.col("doc_id")) != 1)
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("_toxic"))
    )
    chosen = bounded_sample(usable.where("_toxic = 1"), MAX_TOXIC, "doc_id").unionByName(
        bounded_sample(usable.where("_toxic = 0"), MAX_CLEAN, "doc_id")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([packed(t.as_py()) for t in batch.column(2)], pa.binary())], names=["doc_id", "_toxic", "features"])
        release()

    one_each = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_toxic").agg(F.min("text").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = one_each.mapInArrow(pack, f"doc_id {kind}, _toxic int, features binary").toArrow().sort_by("doc_id")
    model = fit_packed(rows.column("features").to_pylist(), rows.column("_toxic").to_pylist())
    del rows
    release()
    return model


def score(docs: DataFrame, model: ToxicityModel, column: str = "toxicity") -> DataFrame:
    """`docs` with a double column of scores after its own columns, which pass through untouched.

    Null and empty texts get the score of a text without features. Rows of equal id are scored each for
    itself. An existing column of that name is replaced.
    """
    docs = docs.drop(column)
    return _scored(docs, model).toDF(*docs.columns, column)


def _scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """`docs` with the score as its last column, of some name."""
    at = docs.columns.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield extended(batch, pa.array([model.score(t.as_py()) for t in batch.column(at)], pa.float64()))
        release()

    return mapped(docs, scored, T.StructField("score", T.DoubleType()))


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents scored below THRESHOLD, with their own columns only."""
    numbers = [str(k) for k in range(len(docs.columns))]
    return _scored(docs, model).toDF(*numbers, "score").where(F.col("score") < THRESHOLD).drop("score").toDF(*docs.columns)


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit_frames(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model, "score").select(
        "doc_id",
        (fold_of(F.col("doc_id")) == 1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
