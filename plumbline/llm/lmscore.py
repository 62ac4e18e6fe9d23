"""Stupid-backoff language-model scores of every document against the whole corpus.

n-grams of one to ORDER words are counted over all documents in hash partitions and joined back to the
documents that hold them (see `grams`). A word scores c(n-gram) / c(context) for the longest n-gram that
other documents have, times BACKOFF for each word of context given up; the logarithms are added up for
each document. A document's own occurrences do not count for it, so rare text scores low and text that
other documents repeat scores high.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import table
from plumbline.llm.grams import BITS, Words, check_totals, gram_hashes, with_corpus_counts

ORDER, BACKOFF = 3, 0.4


def _grams(texts: list) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the n-grams from each word on, and whether they lie in one text, for n = 1..ORDER; each word's text."""
    words = Words(texts)
    owner, halves = np.repeat(np.arange(len(texts)), np.diff(words.begins)), words.halves()
    hashes, inside = [], []
    for n in range(1, ORDER + 1):
        h = gram_hashes(halves, n) >> np.uint64(64 - BITS)
        hashes.append(np.maximum(h, np.uint64(1)))
        inside.append(owner[: len(h)] == owner[n - 1 :] if len(h) else np.zeros(0, bool))
    return hashes, inside, owner


def chunk_grams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and counts; hash 0 stands for all words."""
    hashes, inside, owner = _grams(texts)
    keys, counts = np.unique(np.concatenate([h[ok] for h, ok in zip(hashes, inside)]), return_counts=True)
    if not len(keys):
        return keys, counts
    return np.concatenate([np.zeros(1, np.uint64), keys]), np.concatenate([[len(owner)], counts])


def finish(doc_ids: pa.Array, texts: list, totals: np.ndarray) -> pa.Table:
    hashes, inside, owner = _grams(texts)
    flat = np.concatenate([h[ok] for h, ok in zip(hashes, inside)])
    text = np.concatenate([owner[: len(ok)][ok] for ok in inside])
    # equal hashes stand together after the sort, and as it is stable, so do those of one text
    order = np.argsort(flat, kind="stable")
    flat, text = flat[order], text[order]
    fresh = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
    check_totals(int(fresh.sum()) + bool(len(flat)), totals)
    run = np.cumsum(fresh | np.concatenate([[True], text[1:] != text[:-1]])[: len(flat)]) - 1
    others = np.empty(len(flat))
    others[order] = totals[np.cumsum(fresh)] - np.bincount(run)[run] if len(flat) else 0
    n_words = np.bincount(owner, minlength=len(texts))
    words = float(totals[0]) if len(totals) else 0.0
    score, context, at = np.zeros(len(owner)), np.zeros(len(owner)), 0
    for n, ok in enumerate(inside, 1):
        seen = np.zeros(len(ok))
        seen[ok] = others[at : at + int(ok.sum())]
        at += int(ok.sum())
        if n == 1:  # a word that no other document has counts as half an occurrence
            score = np.where(seen > 0, seen / np.maximum(1.0, words - n_words[owner]), 0.5 / max(1.0, words))
        else:
            end = score[n - 1 :]
            end[ok] = np.where(seen > 0, seen / np.maximum(context[: len(ok)], 1), BACKOFF * end)[ok]
        context = seen
    log = np.bincount(owner, weights=np.log10(score), minlength=len(texts)).astype(float)  # of no words it counts in whole numbers
    mean = np.divide(log, n_words, out=np.zeros(len(texts)), where=n_words > 0)
    return pa.table({"doc_id": doc_ids, "n_words": pa.array(n_words, pa.int64()), "score": pa.array(mean), "log_sum": pa.array(log)})


def lm_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, score, log_sum): the mean and the sum of the decimal logarithms of the words' scores.

    Both are 0 for a null text or one without words; a text may be as long as a row may be. Rows of equal
    doc_id are documents of their own. N-grams are told apart by 56 bits, so of n distinct ones about
    n * n / 2**57 share a count. The documents are read twice; if there is a shuffle in their plan, they
    are written to the shared folder first, so that a task that runs again deals them out as before.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_corpus_counts(docs, chunk_grams, finish, f"doc_id {kind}, n_words long, score double, log_sum double")


def op9_lmscore(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents")).select("doc_id", "n_words", F.round("score", 6).alias("score"), F.round("log_sum", 6).alias("log_sum"))
