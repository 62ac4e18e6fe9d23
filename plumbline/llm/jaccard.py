"""Exact Jaccard self-join of word-shingle sets, for linked groups of documents.

The join skips by set relations. Sets that are equal stand for one another from the start. Shingles are
ordered by how many distinct sets of the corpus hold them, rarest first, and each set is listed under the
shingles of its prefix only: two sets that reach the threshold share one there. Lists are cut in blocks by
set size, and in a list the place of a shingle in a set bounds how large a set it may still link with: its
reach. Rows that no other row of their block can reach are skipped, and a list in order of reach is read
only as far as the asking set's size.

In a first round a leader is compared for its block and its answers serve the others: what is linked to the
leader is joined to all that the leader is joined to. Only sets that the leaders leave in different
components are compared further, list by list. There the sets of one component are asked one after the
other, and each one's overlaps with all others are derived from those of the set before it, by the shingles
in which the two differ.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import checkpointed, deleted, repeatable, shared_folder, swept, table
from plumbline.llm.components import components
from plumbline.llm.grams import BITS, Words, check_totals, gram_hashes, with_corpus_counts

SHINGLE = 5
#: The threshold as a fraction; two sets link at this Jaccard similarity or more.
TOP, BOTTOM = 4, 5
#: Sizes of one block lie within this factor: a little over 5/4, the most that sizes of linked sets differ by.
_BLOCK = 1.26


#: A set: its shingles' first hashes, ascending, and their second ones in the same order.
Set = tuple[np.ndarray, np.ndarray]


def shingle_sets(texts: list) -> list[Set]:
    """The distinct shingles of each text, by two hashes; a text of fewer words has its whole sequence as one."""
    words = Words(texts)
    halves = words.halves()
    every = [gram_hashes(halves, SHINGLE, k) for k in (0, 1)]
    out = []
    for a, b in zip(words.begins.tolist(), words.begins[1:].tolist()):
        if b - a >= SHINGLE:
            s, at = np.unique(every[0][a : b - SHINGLE + 1], return_index=True)
            out.append((s, every[1][a : b - SHINGLE + 1][at]))
        else:
            part = halves[0][a:b], halves[1][a:b]
            out.append(tuple(gram_hashes(part, b - a, k) if b > a else np.zeros(0, np.uint64) for k in (0, 1)))
    return out


def _signature(shingles: Set) -> str:
    return xxhash.xxh3_128_hexdigest(shingles[0].tobytes() + shingles[1].tobytes())


def _distinct(texts: list) -> tuple[list[Set], list[str], dict[str, int]]:
    """The sets, their signatures, and the first text of each signature that isn't empty."""
    sets = shingle_sets(texts)
    signatures = [_signature(s) for s in sets]
    first: dict[str, int] = {}
    for k, (s, name) in enumerate(zip(sets, signatures)):
        if len(s[0]):
            first.setdefault(name, k)
    return sets, signatures, first


def chunk_grams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of the distinct sets of a chunk, and how many of them have each."""
    sets, _, first = _distinct(texts)
    if not first:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(np.concatenate([sets[k][0] for k in first.values()]) >> np.uint64(64 - BITS), return_counts=True)


def finish(doc_ids: pa.Array, texts: list, totals: np.ndarray) -> pa.Table:
    """One row a document, then one for each distinct set that has a list to go in, with its shingles and postings."""
    sets, signatures, first = _distinct(texts)
    keys, _ = chunk_grams(texts)
    check_totals(len(keys), totals)
    members, tokens, places, blobs = [], [], [], []
    for k in first.values():
        s = sets[k][0]
        held = totals[np.searchsorted(keys, s >> np.uint64(64 - BITS))]
        prefix = np.argsort(held, kind="stable")[: len(s) - (TOP * len(s) + BOTTOM - 1) // BOTTOM + 1]
        place = np.flatnonzero(held[prefix] > 1)
        if len(place):
            members.append(k)
            tokens.append(s[prefix[place]].view(np.int64))
            places.append(place)
            blobs.append(s.tobytes() + sets[k][1].tobytes())
    n = len(texts) + len(members)
    names = signatures + [signatures[k] for k in members]
    sizes = [len(s[0]) for s in sets] + [len(sets[k][0]) for k in members]
    none = [None] * len(texts)
    return pa.table({
        "doc_id": pa.concat_arrays([doc_ids, pa.nulls(len(members), doc_ids.type)]),
        "is_set": pa.array([False] * len(texts) + [True] * len(members)),
        "sig": pa.array(names, pa.string()),
        "n": pa.array(sizes, pa.int64()),
        "tokens": pa.array(none + tokens, pa.list_(pa.int64())),
        "places": pa.array(none + places, pa.list_(pa.int64())),
        "shingles": pa.array(none + blobs, pa.binary()),
    }).slice(0, n)


def _reach(n: Column, place: Column) -> Column:
    """TOP times the size of the largest set that a set of n may link with, if a shingle at `place` is their first common one.

    The overlap is n - place at most then, and x and y link if (TOP + BOTTOM) |x & y| >= TOP (|x| + |y|).
    """
    return BOTTOM * n - (TOP + BOTTOM) * place


def _may_link(a_n: Column, a_reach: Column, b_n: Column, b_reach: Column) -> Column:
    sizes = (F.least(a_n, b_n) * BOTTOM) >= (F.greatest(a_n, b_n) * TOP)
    return sizes & (TOP * a_n <= b_reach) & (TOP * b_n <= a_reach)


def _hashes(blob: pa.Scalar) -> np.ndarray:
    """Both hashes of each shingle, as two rows."""
    return np.frombuffer(blob.as_buffer(), np.uint64).reshape(2, -1)


def _linked_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of distinct pairs (a, b) of signatures that link; a may be as frequent as it likes."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                left, right = _hashes(x), _hashes(y)
                at = np.minimum(np.searchsorted(left[0], right[0]), left.shape[1] - 1)
                overlap = int((left[:, at] == right).all(axis=0).sum())
                keep.append(overlap * (TOP + BOTTOM) >= (left.shape[1] + right.shape[1]) * TOP)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda s: sets.select(F.col("sig").alias(s), F.col("shingles").alias(f"s{s}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb")
    return both.mapInArrow(shared, "a string, b string")


#: Sets and shingles of a unit of the second round, on the side of the queries; the other side may be twice as large.
UNIT_SETS, UNIT_SHINGLES = 256, 200_000
#: Rows of lists that are read at a time.
_READ_ROWS = 2_000_000


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of count[0] numbers, then from first[1] on, and so forth."""
    last = np.cumsum(count)
    return np.repeat(first - (last - count), count) + np.arange(last[-1] if len(last) else 0)


class _Lists:
    """The lists of a unit's held sets: by shingle of the prefix, each in order of reach, the furthest first."""

    def __init__(self, owner: np.ndarray, tokens: np.ndarray, reach: np.ndarray) -> None:
        self.tokens = np.unique(tokens)
        self.top = max(1, int(reach.max(initial=0)) + 1)
        key = np.searchsorted(self.tokens, tokens) * self.top + (self.top - 1 - reach)
        order = np.argsort(key, kind="stable")
        self.key, self.owner, self.reach = key[order], owner[order], reach[order]

    def candidates(self, tokens: np.ndarray, reach: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
        """Held sets that may link with a set of `size`, given its prefix; the rest of each list is never read."""
        at = np.searchsorted(self.tokens, tokens)
        known = (at < len(self.tokens)) & (self.top > TOP * size)
        known[known] = self.tokens[at[known]] == tokens[known]
        at, reach = at[known] * self.top, reach[known]
        first = np.searchsorted(self.key, at)
        count = np.searchsorted(self.key, at + (self.top - 1 - TOP * size), side="right") - first
        found, low = [np.zeros(0, np.int64)], 0
        while low < len(first):
            high = max(low + 1, int(np.searchsorted(np.cumsum(count[low:]), _READ_ROWS, side="right")) + low)
            who = self.owner[_spread(first[low:high], count[low:high])]
            found.append(np.unique(who[TOP * sizes[who] <= np.repeat(reach[low:high], count[low:high])]))
            low = high
        return np.unique(np.concatenate(found))


def _numbered(blobs: list[np.ndarray]) -> list[np.ndarray]:
    """The sets of a unit as numbers of shingles, equal where both hashes are."""
    flat = np.concatenate(blobs, axis=1)
    _, where, number = np.unique(flat[0], return_index=True, return_inverse=True)
    if (flat[1][where][number] != flat[1]).any():  # one first hash, two shingles
        number = np.unique(flat.T, axis=0, return_inverse=True)[1].ravel()
    return [np.sort(x) for x in np.split(number, np.cumsum([b.shape[1] for b in blobs])[:-1])]


def _joins(rows: pa.Table, level: int) -> tuple[list[tuple[str, str]], int]:
    """Links of a unit that join different components, as few as join the same ones, and how many pairs were looked at."""
    query, base, size = (rows.column(c).to_numpy() for c in ("is_query", "level", "n"))
    group = np.asarray(rows.column("component").to_pylist(), dtype=object)
    q, m = np.flatnonzero(query), np.flatnonzero(~query)
    if not len(q) or not len(m):
        return [], 0
    sets = _numbered([_hashes(x) for x in rows.column("shingles")])
    tokens = [np.asarray(x.values) for x in rows.column("tokens")]
    reach = [BOTTOM * n - (TOP + BOTTOM) * np.asarray(x.values) for n, x in zip(size, rows.column("places"))]
    lists = _Lists(np.repeat(np.arange(len(m)), [len(tokens[i]) for i in m]), np.concatenate([tokens[i] for i in m]), np.concatenate([reach[i] for i in m]))
    held = np.concatenate([sets[i] for i in m])
    order = np.argsort(held, kind="stable")
    holder = np.repeat(np.arange(len(m)), [len(sets[i]) for i in m])[order]
    first = np.searchsorted(held[order], np.arange(max(int(s[-1]) for s in sets) + 2))

    def overlaps(numbers: np.ndarray) -> np.ndarray:
        return np.bincount(holder[_spread(first[numbers], first[numbers + 1] - first[numbers])], minlength=len(m))

    lead: dict[str, str] = {}

    def root(x: str) -> str:
        while (up := lead.get(x, x)) != x:
            lead[x] = lead.get(up, up)
            x = up
        return x

    forest, looked, before, answer = [], 0, None, None
    for i in sorted(q.tolist(), key=lambda i: (group[i], size[i])):
        near = lists.candidates(tokens[i], reach[i], int(size[i]), size[m])
        near = near[(group[m[near]] != group[i]) & (np.maximum(base[m[near]], base[i]) == level)]
        if not len(near):
            continue
        looked += len(near)
        if before is not None:  # from the answer of the set before, by what one has and the other has not
            more, less = np.setdiff1d(sets[i], before, assume_unique=True), np.setdiff1d(before, sets[i], assume_unique=True)
        if before is not None and len(more) + len(less) < len(sets[i]):
            answer = answer + overlaps(more) - overlaps(less)
        else:
            answer = overlaps(sets[i])
        before = sets[i]
        for j in m[near[answer[near] * (TOP + BOTTOM) >= (size[i] + size[m[near]]) * TOP]].tolist():
            if (x := root(group[i])) != (y := root(group[j])):
                lead[max(x, y)] = min(x, y)
                forest.append((group[i], group[j]))
    return forest, looked


def _joined_unit(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    forest, looked = _joins(rows, key[1].as_py())
    forest.append((None, None))
    return pa.table({"a": pa.array([a for a, _ in forest], pa.string()), "b": pa.array([b for _, b in forest], pa.string()), "looked": pa.array([0] * (len(forest) - 1) + [looked], pa.int64())})


def _second_round(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of components inside the clusters of `members` (sig, n, level, cluster, component).

    In each cluster and size block, the sets outside its largest component are queries against all its
    sets. Both sides are dealt by a hash into units of bounded size, so a large cluster is many units in
    many tasks, and a unit returns at most a link for each component it sees. A row without a link tells
    how many pairs a unit looked at.
    """
    members = members.withColumn("block", F.explode(F.array(F.col("level"), F.col("level") + 1)))
    parts = members.groupBy("cluster", "block", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    main = parts.groupBy("cluster", "block").agg(F.max(F.struct("c", "component", "s")).alias("top"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    main = main.where("top.c < c").select(
        "cluster",
        "block",
        F.col("top.component").alias("main"),
        F.greatest(F.ceil((F.col("c") - F.col("top.c")) / UNIT_SETS), F.ceil((F.col("s") - F.col("top.s")) / UNIT_SHINGLES)).alias("q_units"),
        F.greatest(F.ceil(F.col("c") / (2 * UNIT_SETS)), F.ceil(F.col("s") / (2 * UNIT_SHINGLES))).alias("m_units"),
    )
    # cut off from its aggregate, so that Spark can split the join where a cluster is large
    rows = members.join(checkpointed(main), ["cluster", "block"]).join(sets.select("sig", "shingles", "tokens", "places"), "sig")
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda n, salt: F.pmod(F.xxhash64("sig", F.lit(salt)), F.col(n))
    kept = ["cluster", "block", "component", "n", "level", "tokens", "places", "shingles"]
    asked = rows.where("component <> main").select(*kept, F.lit(True).alias("is_query"), dealt("q_units", "q").alias("q"), up_to("m_units").alias("m"))
    held = rows.select(*kept, F.lit(False).alias("is_query"), dealt("m_units", "m").alias("m"), up_to("q_units").alias("q"))
    return asked.unionByName(held).groupBy("cluster", "block", "q", "m").applyInArrow(_joined_unit, "a string, b string, looked long")


def link_sets(sets: DataFrame) -> DataFrame:
    """(node, component) of the signatures that link with another, from distinct (sig, n, tokens, places, shingles).

    No block gives all its pairs. A first round compares each set with one leader of its blocks, the set
    with the most shared shingles in its prefix, which in a family of near copies is the one with the
    fewest edits. A second round compares what the first leaves in different components, inside the
    clusters of sets that blocks hold together.
    """
    level = F.floor(F.log(_BLOCK, F.col("n").cast("double"))).cast("int")
    listed = sets.select("sig", "n", level.alias("level"), F.size("tokens").alias("k"), F.explode(F.arrays_zip("tokens", "places")).alias("p"))
    listed = listed.select("sig", "n", "k", F.col("p.tokens").alias("token"), _reach(F.col("n"), F.col("p.places")).alias("reach"), F.explode(F.array(F.col("level"), F.col("level") + 1)).alias("block"))
    blocks = listed.groupBy("token", "block").agg(F.max(F.struct("k", "sig", "n", "reach")).alias("leader"), F.min("n").alias("least"), F.max("reach").alias("furthest"), F.count(F.lit(1)).alias("members"))
    blocks = checkpointed(blocks.where("members > 1").drop("members"))
    led = listed.join(blocks, ["token", "block"]).where((F.col("sig") != F.col("leader.sig")) & (F.col("reach") >= TOP * F.col("least")) & (F.col("furthest") >= TOP * F.col("n")))
    may = _may_link(F.col("n"), F.col("reach"), F.col("leader.n"), F.col("leader.reach"))
    edges = checkpointed(led.groupBy(F.col("sig").alias("b"), F.col("leader.sig").alias("a")).agg(F.max("leader.k").alias("k"), F.max(may).alias("may")))
    first = edges.where("may").groupBy("b").agg(F.max(F.struct("k", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    links = checkpointed(_linked_pairs(first, sets))
    groups = components(links)
    clusters = components(edges).withColumnRenamed("component", "cluster")
    members = clusters.join(groups, "node", "left").select(F.col("node").alias("sig"), "cluster", F.coalesce("component", "node").alias("component"))
    members = checkpointed(members.join(sets.select("sig", "n", level.alias("level")), "sig"))
    more = checkpointed(_second_round(members, sets)).where("a IS NOT NULL").select("a", "b").distinct()
    if more.isEmpty():
        return groups
    return components(links.unionByName(more))


def _labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, n, sig, component) of every row; component: the name of its group, its own signature if it links with nothing."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = with_corpus_counts(docs, chunk_grams, finish, f"doc_id {kind}, is_set boolean, sig string, n long, tokens array<long>, places array<long>, shingles binary")
    path = posixpath.join(shared_folder(spark), f"jaccard-{uuid.uuid4().hex}")
    made.write.parquet(path)
    made = spark.read.schema(made.schema).parquet(path)
    swept(spark)  # the counts' shuffles are twice the input
    sets = checkpointed(made.where("is_set").select("sig", "n", "tokens", "places", "shingles").dropDuplicates(["sig"]))
    rows = checkpointed(made.where("not is_set").select("doc_id", "n", "sig"))
    deleted(spark, path)
    swept(spark)
    groups = link_sets(sets)
    return checkpointed(rows.join(groups.withColumnRenamed("node", "sig"), "sig", "left").select("doc_id", "n", "sig", F.coalesce("component", "sig").alias("component")))


def linked_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs`.

    component_id is the smallest doc_id that links reach, the document itself included. A null or empty
    text, or one without words, has no shingles and links with nothing. Rows of equal doc_id are
    documents of their own that share a name. A text may be as long as a row may be.
    """
    rows = _labelled(docs)
    least = checkpointed(rows.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id")))
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.where("n > 0").join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


#: Ids of dropped documents are broadcast up to this many; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def _few(df: DataFrame) -> DataFrame:
    """A table of ids, cut off from its plan, to be broadcast if it is small enough."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _signed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, sig): each row of `docs` as a struct, and the signature of its set, null without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = [_signature(s) if len(s[0]) else None for s in shingle_sets(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(signed, pa.string())], names=["row", "doc_id", "sig"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text")
    return rows.mapInArrow(sign, T.StructType([rows.schema["row"], rows.schema["doc_id"], T.StructField("sig", T.StringType())]))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each linked group, the row of the smallest doc_id, with its own columns; an id goes before none.

    Rows without words all stay. Of rows of one doc_id and one set of shingles, any one may stay.
    """
    docs, columns = repeatable(docs), [F.col(f"`{c}`") for c in docs.columns]
    rows = _labelled(docs)
    twice = _few(rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), F.col("doc_id").alias("id"), F.col("sig").alias("first_sig")))
    least = checkpointed(rows.where("n > 0").groupBy("component").agg(first.alias("first")).select("component", "first.*"))
    others = rows.where("n > 0 AND doc_id IS NOT NULL").join(least, "component").where(~F.col("doc_id").eqNullSafe(F.col("id")))
    plain = docs.where("doc_id IS NOT NULL").join(_few(others.select("doc_id").distinct()), "doc_id", "left_anti").select(*columns)
    if twice.isEmpty() and rows.where("doc_id IS NULL").isEmpty():
        return plain
    # rows that their id does not tell apart, by id and signature
    shared = docs.where("doc_id IS NOT NULL").join(twice, "doc_id", "left_semi").select(*columns).unionByName(docs.where("doc_id IS NULL"))
    signed = _signed(shared)
    one = signed.where("sig IS NOT NULL").join(least, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sig") == F.col("first_sig")), "left_semi").groupBy("doc_id", "sig").agg(F.first("row").alias("row"))
    kept = one.select("row").unionByName(signed.where("sig IS NULL").select("row"))
    return plain.join(twice, "doc_id", "left_anti").select(*columns).unionByName(kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns)))


def op10_jaccard(spark, sf_dir):
    return linked_groups(table(spark, sf_dir, "documents"))
