"""Language identification by the nearest of several TF-IDF centroids per language.

A text becomes a unit vector of hashed character n-gram TF-IDF values. Training vectors of each
language are clustered by spherical k-means into a few centroids; a text takes the language of the
centroid with the largest cosine, the first by name if several have it. A text further from its centroid than nearly all of that centroid's
training texts is flagged as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import checkpointed, extended, fold_of, mapped, release, table

NGRAMS = (1, 2, 3)
BITS = 14
CENTROIDS = 3
#: Bounds of the fit: rows of a language, and rows in all unless that leaves fewer than LEAST_ROWS for a language.
MAX_ROWS, MAX_FIT_ROWS, LEAST_ROWS = 1000, 8000, 20
ROUNDS = 8
#: Languages whose shares are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
#: A text is rejected below this quantile of the cosines that a centroid's own training texts have.
REJECT_QUANTILE = 0.01

_MULTIPLY, _ADD, _SPREAD = np.uint32(0x01000193), np.uint32(0x85EBCA6B), np.uint32(2654435761)
_LETTER = regex.compile(r"\p{L}")


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of a text, ascending, and how often each occurs."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    rolling, total = np.zeros(len(points), np.uint32), np.zeros(1 << BITS, np.int64)
    for n in range(1, NGRAMS[-1] + 1):
        if len(points) < n:
            break
        rolling = rolling[: len(points) - n + 1] * _MULTIPLY + points[n - 1 :] * _ADD
        if n in NGRAMS:
            total += np.bincount(((rolling + np.uint32(n)) * _SPREAD) >> np.uint32(32 - BITS), minlength=1 << BITS)
    seen = np.flatnonzero(total)
    return seen, total[seen]


@dataclass
class LanguageModel:
    """centroids: unit rows; language: index into names for each row; floor: cosine below which a text is rejected."""

    names: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    language: np.ndarray
    floor: np.ndarray

    def vector(self, seen: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value = (1.0 + np.log(n)) * self.idf[seen]
        return seen, value / max(1e-12, float(np.sqrt(np.dot(value, value))))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine of the nearest centroid in [0, 1], and whether that is too far."""
        if not self.names or not text or not _LETTER.search(text):
            return "und", 0.0, True
        seen, value = self.vector(*counts(text))
        cosine = value @ self.by_feature[seen]
        best = int(np.argmax(cosine))
        near = float(min(1.0, max(0.0, cosine[best])))
        return self.names[self.language[best]], near, near < self.floor[best]

    def __post_init__(self) -> None:
        self.by_feature = np.ascontiguousarray(self.centroids.T)


def fit(texts: list[str], langs: list[str]) -> LanguageModel:
    return fit_counts([counts(t) for t in texts], langs)


def fit_counts(found: list[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> LanguageModel:
    """A model from the n-gram counts of texts. Without rows nothing is learned and every text is `und`."""
    names = sorted(set(langs))
    df = np.zeros(1 << BITS)
    for seen, _ in found:
        df[seen] += 1
    model = LanguageModel(names, np.log((1 + len(found)) / (1 + df)) + 1, np.zeros((0, 1 << BITS)), np.zeros(0, int), np.zeros(0))
    rows, language, floor = [], [], []
    for k, name in enumerate(names):
        sparse = [model.vector(*x) for x, lang in zip(found, langs) if lang == name]
        size = min(CENTROIDS, len(sparse))
        flat, owner = np.concatenate([s for s, _ in sparse]), np.repeat(np.arange(len(sparse)), [len(s) for s, _ in sparse])
        value = np.concatenate([v for _, v in sparse])
        group = np.arange(len(sparse)) % size
        for _ in range(ROUNDS):
            centre = np.stack([np.bincount(flat, weights=value * (group[owner] == c), minlength=1 << BITS) for c in range(size)])
            centre /= np.maximum(1e-12, np.sqrt((centre**2).sum(axis=1, keepdims=True)))
            cosine = np.stack([np.bincount(owner, weights=value * centre[c][flat], minlength=len(sparse)) for c in range(size)])
            moved = cosine.argmax(axis=0)
            if (moved == group).all():
                break
            group = moved
        best = cosine.max(axis=0)
        for c in range(size):
            rows.append(centre[c].astype(np.float32))
            language.append(k)
            floor.append(float(np.quantile(best[group == c], REJECT_QUANTILE)) if (group == c).any() else 1.0)
    if not rows:
        return model
    return LanguageModel(names, model.idf, np.stack(rows), np.asarray(language), np.asarray(floor))


def fit_frames(docs: DataFrame) -> LanguageModel:
    """Learns from (doc_id, text, lang) outside the held-out fold; rows without a text, letter or language are left out.

    Every language with a usable row is learned: the rows of each are counted, then up to MAX_ROWS of each,
    and MAX_FIT_ROWS in all, or LEAST_ROWS of each if that is more, are taken by a hash of the id. Texts are
    read whole, on the executors; the n-gram counts of one text have a fixed bound.
    """
    usable = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND doc_id IS NOT NULL").where(fold_of(F.col("doc_id")) != 1).where(F.col("text").rlike(r"\p{L}"))
    sizes = checkpointed(usable.groupBy("lang").count())
    known = sizes.count()
    each = min(MAX_ROWS, max(LEAST_ROWS, MAX_FIT_ROWS // max(1, known)))
    bar = sizes.select("lang", F.least(F.lit(1.0), F.lit(0.95 * each) / F.col("count")).alias("_share"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(t.as_py()) for t in batch.column(2)]
            seen, n = ([x[k].astype(kind).tobytes() for x in found] for k, kind in enumerate(("<u2", "<u4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(seen, pa.binary()), pa.array(n, pa.binary())], names=["doc_id", "lang", "seen", "n"])
        release()

    chosen = usable.join(F.broadcast(bar) if known <= BROADCAST_ROWS else bar, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("_share") * (1 << 30))
    chosen = chosen.select("doc_id", "lang", "text").limit(max(MAX_FIT_ROWS, each * known))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = chosen.mapInArrow(pack, f"doc_id {kind}, lang string, seen binary, n binary").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("seen", "ascending"), ("n", "ascending")])
    found = [(np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(b, "<u4")) for a, b in zip(rows.column("seen").to_pylist(), rows.column("n").to_pylist())]
    return fit_counts(found, rows.column("lang").to_pylist())


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """`docs` with lang_pred, lang_score and lang_rejected after its own columns.

    Rows of equal id are judged each for itself. A null text, or one without a letter, is `und` with score 0 and rejected. Columns of `docs` that
    have one of the three names are replaced.
    """
    added = ["lang_pred", "lang_score", "lang_rejected"]
    docs = docs.drop(*added)
    at = docs.columns.index("text")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column(at).to_pylist()]
            yield extended(batch, *(pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))))
        release()

    return mapped(docs, judged, *(T.StructField(name, kind) for name, kind in zip(added, (T.StringType(), T.DoubleType(), T.BooleanType()))))


def op8_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit_frames(docs))
    return found.select(
        "doc_id",
        (fold_of(F.col("doc_id")) == 1).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_rejected").alias("rejected"),
    )
