"""Counts of word n-grams over a whole corpus, joined back to the documents that hold them.

The steps are relational, on columns of n-grams instead of rows. Documents are read in chunks of bounded
size. Each chunk explodes into its distinct n-gram hashes, with its own counts, and deals them to hash
partitions; a partition builds the count table of its range of hashes from what all chunks sent, joins it
to each chunk's hashes and returns the totals in the order they were asked for. A chunk's documents travel
beside as one compressed row and meet the totals again by the chunk's name. So each distinct n-gram of a
chunk crosses the network once however often it occurs, and one that every document holds costs no
partition more than a row a chunk. Hashes go out as sorted differences of five bytes or so, counts in as few
bytes as they fit: as rows of Spark the same n-grams would take several times the disk that the input does.

A chunk sends a row to each partition that it has n-grams for. Both numbers grow with the input, but there
are never more such rows than n-grams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import release, repeatable

#: Text bytes of a chunk and of a hash partition.
CHUNK_BYTES, PART_BYTES = 4 << 20, 8 << 20
#: Bits of a hash that leaves its chunk.
BITS = 56

_random = np.random.default_rng(20240607)
_odd = lambda n: _random.integers(0, 2**64 - 1, n, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))  # A-Z count as a-z
#: The first n bytes of eight.
_FIRST = np.asarray([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_ROUNDS = _odd(4)
#: Factors of either half of each word of an n-gram, and what tells lengths apart, for two hashes.
_FACTORS, _LENGTHS = _odd(32).reshape(2, 2, 8), _odd(18).reshape(2, 9)


def mixed(h: np.ndarray) -> np.ndarray:
    """Each 64-bit value spread over all bits, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of some texts in order: runs of bytes other than blank and 0x09-0x0D, A-Z taken for a-z.

    data: the texts' bytes; starts, ends: of each word there; begins: where each text's words begin (an
    entry more than texts). low, high: 128 bits that name a word: a word of up to 16 bytes is those bytes,
    a longer one (or one with a byte 0) its xxh3, so words of one name are equal.
    """

    def __init__(self, texts: list[str | None]) -> None:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        at = np.cumsum([1, *(len(r) + 1 for r in raw)])
        self.data = b"\n".join([b"", *raw, b""]).translate(_FOLD) + bytes(16)
        shown = np.frombuffer(self.data, np.uint8)
        space = _SPACE[shown[:-16]]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.starts, self.ends = edge[::2], edge[1::2]
        self.begins = np.searchsorted(self.starts, at)
        size = self.ends - self.starts
        eight = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))  # from each byte on
        self.low = eight[self.starts] & _FIRST[np.minimum(size, 8)]
        self.high = eight[self.starts + 8 * (size > 8)] & _FIRST[np.clip(size - 8, 0, 8)]
        named = size > 16
        if (zero := np.flatnonzero(shown[:-16] == 0)).size:
            named[np.searchsorted(self.starts, zero, side="right") - 1] = True
        where, view = np.flatnonzero(named), memoryview(self.data)
        digests = b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(self.starts[where].tolist(), self.ends[where].tolist())])
        self.low[where], self.high[where] = np.frombuffer(digests, "<u8").reshape(-1, 2).T

    def __len__(self) -> int:
        return len(self.starts)

    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        """The 128 bits of each word spread over all bits, one to one."""
        low, high = self.low, self.high
        for k in range(0, 4, 2):
            high = high ^ mixed(low + _ROUNDS[k])
            low = low ^ mixed(high + _ROUNDS[k + 1])
        return low, high


def gram_hashes(halves: tuple[np.ndarray, np.ndarray], n: int, which: int = 0) -> np.ndarray:
    """One of two hashes of the n words from each position on; fewer than n words have none."""
    count = len(halves[0]) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(count, _LENGTHS[which, n])
    for half, factors in zip(halves, _FACTORS[which]):
        for j in range(n):
            total += half[j : j + count] * factors[j]
    return mixed(total)


# ---- chunks and the exchange


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    """(name, rows) of chunks of (doc_id, text); the same rows of the same partition give the same name."""
    part, n, waiting, size = TaskContext.get().partitionId(), 0, [], 0

    def close() -> tuple[str, pa.RecordBatch]:
        rows = pa.concat_batches(waiting)
        digest = xxhash.xxh3_128(f"{part} {n}")
        digest.update(_packed(rows))
        return digest.hexdigest(), rows

    for batch in batches:
        length = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(1)])
        low = 0
        while low < batch.num_rows:
            room = CHUNK_BYTES - size + (int(length[low - 1]) if low else 0)
            high = max(low + 1, int(np.searchsorted(length, room, side="right")))
            waiting.append(batch.slice(low, high - low))
            size += int(length[high - 1]) - (int(length[low - 1]) if low else 0)
            low = high
            if size >= CHUNK_BYTES or low < batch.num_rows:
                yield close()
                waiting, size, n = [], 0, n + 1
    if waiting:
        yield close()


def _packed(rows: pa.RecordBatch) -> bytes:
    rows = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in rows.columns], names=["doc_id", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def encode_keys(keys: np.ndarray) -> bytes:
    """Ascending distinct values below 2**BITS."""
    gaps = np.diff(keys)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def decode_keys(data: bytes) -> np.ndarray:
    width = data[0]
    body = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(body) + 1, 8), np.uint8)
    out[0] = np.frombuffer(data, np.uint8, 8, offset=1)
    out[1:, :width] = body
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def encode_counts(counts: np.ndarray) -> bytes:
    """A byte each; 255 stands for a larger count, which follows after all in eight bytes."""
    large = counts[counts >= 255].astype("<u8")
    return len(counts).to_bytes(8, "little") + np.minimum(counts, 255).astype(np.uint8).tobytes() + large.tobytes()


def decode_counts(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    out = np.frombuffer(data, np.uint8, n, offset=8).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=8 + n)
    return out


def check_totals(hashes: int, totals: np.ndarray) -> None:
    if len(totals) != hashes:
        raise RuntimeError("the documents were dealt out differently when they were read again")


Grams = Callable[[list], tuple[np.ndarray, np.ndarray]]


def with_corpus_counts(docs: DataFrame, grams: Grams, finish: Callable[[pa.Array, list, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """Rows that `finish` makes of each chunk and the corpus-wide counts of its n-grams.

    grams(texts) -> (ascending distinct hashes below 2**BITS, counts) says what a chunk counts.
    finish(doc_ids, texts, totals) -> a table of `schema` for the same texts; totals by ascending hash.
    It raises if there are not as many totals as hashes.
    """
    docs = repeatable(docs.select("doc_id", "text"))
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in _chunks(batches):
            keys, counts = grams(rows.column(1).to_pylist())
            if not len(keys):
                continue
            part = ((keys >> np.uint64(BITS - 32)) * np.uint64(parts)) >> np.uint64(32)
            first = np.flatnonzero(np.diff(part, prepend=part[:1] + np.uint64(1)))
            cuts = [(int(part[a]), encode_keys(keys[a:b]), encode_counts(counts[a:b])) for a, b in zip(first, [*first[1:], len(keys)])]
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cuts], pa.int64()), pa.array([name] * len(cuts)), pa.array([c[1] for c in cuts], pa.binary()), pa.array([c[2] for c in cuts], pa.binary())], names=["part", "chunk", "keys", "counts"])
            del keys, counts, part, cuts
        release()

    def answer(rows: pa.Table) -> pa.Table:
        keys = [decode_keys(k) for k in rows.column("keys").to_pylist()]
        counts = np.concatenate([decode_counts(c) for c in rows.column("counts").to_pylist()])
        # the partition's count table, and its join to the hashes of each chunk
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        first = np.flatnonzero(np.diff(every[order], prepend=~every[order][:1]))
        known, totals = every[order][first], np.add.reduceat(counts[order], first)
        del every, counts, order, first
        out = [encode_counts(totals[np.searchsorted(known, k)]) for k in keys]
        answered = pa.table({"part": rows.column("part"), "chunk": rows.column("chunk"), "totals": pa.array(out, pa.binary())})
        del keys, known, totals, out
        release()
        return answered

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for name, rows in _chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([press.compress(_packed(rows))], pa.binary())], names=["chunk", "rows"])
        release()

    def close(left: pa.Table, right: pa.Table) -> pa.Table:
        with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(left.column("rows")[0].as_py())) as stream:
            rows = stream.read_all()
        replies = right.sort_by("part").column("totals").to_pylist()
        totals = np.concatenate([np.zeros(0, np.int64), *map(decode_counts, replies)])
        finished = finish(rows.column("doc_id").combine_chunks(), rows.column("text").to_pylist(), totals)
        del rows, totals, replies
        release()
        return finished

    asked = docs.mapInArrow(ask, "part long, chunk string, keys binary, counts binary")
    answered = asked.groupBy("part").applyInArrow(answer, "part long, chunk string, totals binary")
    packed = docs.mapInArrow(pack, "chunk string, rows binary")
    return packed.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(close, schema)
