"""Packing of documents into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows of CAPACITY ids, each a sequence of its own, and a rest. The
rests of a group of documents are packed together: every rest starts as a partial partition of k windows
of which one is filled; the two partial partitions with the largest imbalance are merged again and again,
the fullest windows of one onto the emptiest of the other, until one partition is left. k starts at the
fewest windows that can hold the ids and rises while a window exceeds the capacity.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import release, repeatable, slices, table
from plumbline.llm.grams import Words, mixed

CAPACITY = 4096
#: Ids of the longest piece that is packed with others; a longer rest is cut into pieces of this length.
PIECE = 1024
#: Documents of one packing group.
GROUP_ROWS = 1024
END_ID = 2
VOCABULARY = "word_bpe_49k.json"

#: Text bytes that are encoded together.
ENCODE_BYTES = 2 << 20
#: A worker that has kept the ids of more distinct words than this starts afresh (about 40 bytes a word).
_KEPT_WORDS = 1_500_000


def _vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Encoder:
    """Ids of texts, the same as the tokenizer's own.

    The vocabulary drops white space and never joins over it, so texts are encoded word by word: words
    are found and hashed for many texts at once, and only words not seen before go to the tokenizer.
    That holds for texts of common Latin characters; any other text, and one that may hold a special
    token, goes through the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.odd = re.compile(r"<\||[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
        self.unusual = regex.compile(r"<\||[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ‐-‧]")
        self._forget()

    def _forget(self) -> None:
        """No word kept: hashes ascending, each word's name, first place and number of ids in `ids`."""
        self.words, self.names = np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, hashes: np.ndarray, names: np.ndarray, words: list[bytes]) -> None:
        """Keeps the ids of new words, given by ascending hash."""
        first, count, ids = [], [], [self.ids]
        place = len(self.ids)
        for at in range(0, len(words), 20_000):  # one text of many words; its ids are told apart by where they begin
            text = b" ".join(words[at : at + 20_000]).decode("utf-8", "surrogatepass")
            encoded = self.tokenizer.encode(text, add_special_tokens=False)
            begins = np.cumsum([0, *(len(w) + 1 for w in text.split(" "))])
            cuts = np.searchsorted(np.asarray([a for a, _ in encoded.offsets], dtype=np.int64), begins)
            first.append(cuts[:-1] + place)
            count.append(np.diff(cuts))
            ids.append(np.asarray(encoded.ids, dtype="<u4"))
            place += len(ids[-1])
        at = np.searchsorted(self.words, hashes)
        self.words, self.names = np.insert(self.words, at, hashes), np.insert(self.names, at, names, axis=0)
        self.first = np.insert(self.first, at, np.concatenate(first))
        self.count = np.insert(self.count, at, np.concatenate(count))
        self.ids = np.concatenate(ids)

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        out = [self.ids[:0]] * len(texts)
        plain = []
        for k, t in enumerate(texts):
            if not t:
                continue
            if self.odd.search(t) if t.isascii() else self.unusual.search(t) or not unicodedata.is_normalized("NFC", t):
                out[k] = self._whole(t)
            else:
                plain.append(k)
        found = Words([texts[k].lower() for k in plain])
        if not len(found):
            return out
        if len(self.words) > _KEPT_WORDS:
            self._forget()
        words, where, which = np.unique(found.halves()[0], return_index=True, return_inverse=True)
        names = np.stack([found.low, found.high], axis=1)
        at = np.searchsorted(self.words, words)
        new = np.ones(len(words), bool)
        new[at < len(self.words)] = self.words[at[at < len(self.words)]] != words[at < len(self.words)]
        if new.any():
            self._learn(words[new], names[where[new]], [found.data[a:b] for a, b in zip(found.starts[where[new]].tolist(), found.ends[where[new]].tolist())])
            at = np.searchsorted(self.words, words)
        # a word that only shares another's hash sends its text through the tokenizer whole
        other = np.flatnonzero((self.names[at][which] != names).any(axis=1))
        count = self.count[at][which]
        last = np.cumsum(count)
        ids = self.ids[np.repeat(self.first[at][which] - (last - count), count) + np.arange(last[-1])]
        cuts = np.concatenate([[0], last])[found.begins]
        for k, a, b in zip(plain, cuts, cuts[1:]):
            out[k] = ids[a:b]
        for k in {plain[n] for n in (np.searchsorted(found.begins, other, side="right") - 1).tolist()}:
            out[k] = self._whole(texts[k])
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, kept for the life of the process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str | None = None, place: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, _deal) of every piece; a null text has the end id alone.

    Texts are encoded whole. Only lengths and checksums leave the task. _deal is the long column `place` if
    named, else a hash of the piece's place in its task, so neither rows of one id nor equal rows meet.
    """
    docs = docs if place else repeatable(docs)  # with `place`, what a piece is dealt by does not hang on the order
    path = path or _vocabulary_path()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, _deal long"
    end = np.asarray([END_ID], dtype="<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, n, task = encoder(path).encode_many, 0, TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, 1, ENCODE_BYTES):
                row, rest = [], []
                for k, ids in enumerate(encode(part.column(1).to_pylist())):
                    ids = np.concatenate([ids, end])
                    for start in range(0, len(ids), CAPACITY):
                        window = ids[start : start + CAPACITY]
                        step = CAPACITY if len(window) == CAPACITY else PIECE
                        for low in range(0, len(window), step):
                            piece = window[low : low + step]
                            row.append(k)
                            rest.append((start + low, len(piece), zlib.crc32(piece), len(ids)))
                numbers = np.asarray(rest, np.int64).T
                if place:
                    deal = part.column(2).take(pa.array(row, pa.int64()))
                else:
                    deal = pa.array(mixed(np.arange(n, n + len(row), dtype=np.uint64) + np.uint64(task << 40)).view(np.int64))
                n += len(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), *map(pa.array, numbers), deal], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_deal"])
        release()

    return docs.select("doc_id", "text", *([place] if place else [])).mapInArrow(cut, schema)


def _difference(sizes: list[int], k: int) -> list[list[int]]:
    """Members of each of k windows, by multiway differencing of the sizes."""
    heap = []
    for i, s in enumerate(sizes):  # (-imbalance, age, window sums ascending, what fills each window: an item, a join of two or -1)
        heap.append((-s, i, np.asarray([0] * (k - 1) + [s]), np.asarray([-1] * (k - 1) + [i])))
    heapq.heapify(heap)
    n = age = len(sizes)
    joined: list[tuple[int, int]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        sums, left, right = a[2] + b[2][::-1], a[3], b[3][::-1]
        fill = np.maximum(left, right)
        both = np.flatnonzero((left >= 0) & (right >= 0))
        if len(both):
            fill[both] = np.arange(n + len(joined), n + len(joined) + len(both))
            joined += zip(left[both].tolist(), right[both].tolist())
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (int(sums[0] - sums[-1]), age, sums, fill[order]))
        age += 1
    out = []
    for top in heap[0][3].tolist():
        members, todo = [], [top] if top >= 0 else []
        while todo:
            x = todo.pop()
            if x < n:
                members.append(x)
            else:
                todo += joined[x - n]
        out.append(members)
    return out


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Indices of the sizes in near-equal windows of at most `capacity`; every size must fit one."""
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = [p for p in _difference(sizes, k) if p]
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return parts
        k += 1


def _in_order(number: np.ndarray, place: np.ndarray, start: np.ndarray, length: np.ndarray, whole: int) -> np.ndarray:
    """New numbers of a group's windows, given each piece's window, `whole` windows of one piece first.

    Whole windows go where their document stands; the others, by the mean place of their ids, are spread
    evenly over the group, as each of them holds documents from all over it.
    """
    place = place - place.min()
    when = np.bincount(number, weights=place * length) / np.bincount(number, weights=length)
    rest = np.argsort(when[whole:], kind="stable")
    when[whole + rest] = (np.arange(len(rest)) + 0.5) / max(1, len(rest)) * (place.max() + 1)
    first = np.zeros(len(when), np.int64)
    first[number[:whole]] = start[:whole]
    out = np.empty(len(when), np.int64)
    out[np.lexsort((first, when))] = np.arange(len(when))
    return out[number]


def pack(docs: DataFrame, path: str | None = None, place: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece.

    Pieces are dealt to groups evenly, one group for GROUP_ROWS documents, and those of a very long
    document spread over all groups. sequence_id is the group's number times 2**31 plus the window's
    number in the group. Rows of equal doc_id are packed like any others; a null text is an empty one.
    `docs` should give the same rows in the same order when a lost task is run again, as files do; if
    there is a shuffle in its plan it is written to the shared folder first.

    `place` names a column of row numbers from 0 on that the sequences are to follow: groups are then
    GROUP_ROWS consecutive rows, and sequence_id ascends along them.
    """
    cut = pieces(docs, path, place)
    groups = 0 if place else max(1, -(-docs.count() // GROUP_ROWS))
    cut = cut.withColumn("_group", F.floor(F.col("_deal") / GROUP_ROWS) if place else F.pmod("_deal", F.lit(groups)))
    schema = cut.drop("_group", "_deal").schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", sequence_id long, offset long"

    def deal(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns("_group").sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        length = rows.column("length").to_numpy()
        whole = int((length == CAPACITY).sum())  # these stand first
        number, offset = np.arange(len(length)), np.zeros(len(length), np.int64)
        for n, members in enumerate(windows(length[whole:].tolist())):
            at = 0
            for i in members:
                number[whole + i], offset[whole + i] = whole + n, at
                at += length[whole + i]
        if place:
            number = _in_order(number, rows.column("_deal").to_numpy(), rows.column("start").to_numpy(), length, whole)
        return rows.drop_columns("_deal").append_column("sequence_id", pa.array((key[0].as_py() << 31) + number, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return cut.groupBy("_group").applyInArrow(deal, schema)


def op3_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
