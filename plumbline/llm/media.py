"""Copies of images, cropped, turned, resized or edited, by local descriptors.

Corners are found at several scales, as many as an image's size gives room for, each with the direction of
its patch's intensity centroid; 128 binary brightness tests, turned by that direction, describe it.
Descriptors meet in hash tables of their 32-bit parts, so two that differ in fewer bits than there are parts
always meet in one, and more distant ones often. Matches that agree in scale, rotation and shift count as
one consensus; enough of them make two images copies. Byte-equal images stand for one another from the
start. A first round compares each descriptor with its bucket's first one only; a second compares what the
first leaves in different classes, in units of bounded size, so classes are those that all pairs of all
buckets would give.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed, table
from plumbline.llm.components import components

#: Scales of a pyramid, each a step smaller than the one before; pixels of a level for each of its corners, and corners at least.
STEP, LEVELS, PIXELS_A_CORNER, CORNERS = 0.8, 3, 400, 8
#: Half width of a described patch, of the window that corners are the best of, and of the corner sums.
PATCH, BEST_OF, SUMMED = 15, 3, 2
TESTS, PARTS = 128, 4
#: Bits that matched descriptors may differ in; width of a shift's bin in pixels; bins of a full turn; matches that make a copy.
MAX_BITS, BIN, TURNS, MIN_MATCHES = 16, 12, 12, 6

#: Descriptors of a bucket's unit of the second round, on the side of the queries; the other side may be twice as large.
UNIT_ROWS = 1024
#: Descriptors of queries that are broadcast in their buckets; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
#: Corners that are described together.
_TOGETHER = 4096

_random = np.random.default_rng(41)
_PAIRS = _random.uniform(-0.7 * PATCH, 0.7 * PATCH, (TESTS, 2, 2))
_DY, _DX = (g.ravel() for g in np.mgrid[-PATCH : PATCH + 1, -PATCH : PATCH + 1])
_DISC = np.hypot(_DY, _DX) <= PATCH
_DY, _DX = _DY[_DISC], _DX[_DISC]


def encode_pgm(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def decode_pgm(data: bytes | None) -> np.ndarray | None:
    """Grey values of a binary graymap, None for anything else."""
    m = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", data or b"")
    if not m or len(data) - m.end() < int(m[1]) * int(m[2]) or not int(m[1]) * int(m[2]):
        return None
    return np.frombuffer(data, np.uint8, int(m[1]) * int(m[2]), offset=m.end()).reshape(int(m[2]), int(m[1])).astype(np.float32)


def _resized(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres on pixel centres."""
    out = pixels
    for axis, n in ((0, height), (1, width)):
        at = np.clip((np.arange(n) + 0.5) * out.shape[axis] / n - 0.5, 0, out.shape[axis] - 1)
        low = np.minimum(at.astype(int), max(0, out.shape[axis] - 2))
        high, part = np.minimum(low + 1, out.shape[axis] - 1), (at - low).astype(np.float32)
        part = part[:, None] if axis == 0 else part
        out = np.take(out, low, axis) * (1 - part) + np.take(out, high, axis) * part
    return out


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Sums over windows of 2r + 1, edges repeated."""
    for axis in (0, 1):
        c = np.cumsum(np.pad(x, [(r + 1, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge"), axis=axis, dtype=np.float64)
        x = (c[2 * r + 1 :] - c[: -2 * r - 1]) if axis == 0 else (c[:, 2 * r + 1 :] - c[:, : -2 * r - 1])
    return x.astype(np.float32)


def _highest(x: np.ndarray, r: int) -> np.ndarray:
    """The largest value of the window of 2r + 1 around each one."""
    for axis in (0, 1):
        wide = np.pad(x, [(r, r) if a == axis else (0, 0) for a in (0, 1)], constant_values=-np.inf)
        n = x.shape[axis]
        x = np.maximum.reduce([np.take(wide, range(k, k + n), axis) for k in range(2 * r + 1)])
    return x


Corners = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _level(image: np.ndarray) -> Corners:
    """(x, y, direction, first half, second half of the tests) of a level's corners, the strongest first."""
    gy, gx = np.gradient(image)
    xx, yy, xy = (_box(p, SUMMED) for p in (gx * gx, gy * gy, gx * gy))
    corner = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    inner = corner[PATCH:-PATCH, PATCH:-PATCH].copy()
    inner[(inner < _highest(inner, BEST_OF)) | (inner <= 0)] = 0
    best = np.argsort(-inner, axis=None, kind="stable")[: max(CORNERS, image.size // PIXELS_A_CORNER)]
    best = best[inner.ravel()[best] > 0]
    ys, xs = (a + PATCH for a in np.unravel_index(best, inner.shape))
    smooth, parts = _box(image, 1), []
    for low in range(0, len(ys), _TOGETHER):
        y, x = ys[low : low + _TOGETHER, None], xs[low : low + _TOGETHER, None]
        patch = image[y + _DY, x + _DX]
        turn = np.arctan2(patch @ _DY, patch @ _DX)
        c, s = np.cos(turn)[:, None, None], np.sin(turn)[:, None, None]
        px, py = (np.rint(a).astype(int) for a in (_PAIRS[..., 0] * c - _PAIRS[..., 1] * s, _PAIRS[..., 0] * s + _PAIRS[..., 1] * c))
        value = smooth[np.clip(y[..., None] + py, 0, image.shape[0] - 1), np.clip(x[..., None] + px, 0, image.shape[1] - 1)]
        halves = np.packbits(value[..., 0] < value[..., 1], axis=1).view(np.int64)
        parts.append((turn, halves[:, 0], halves[:, 1]))
    turn, d1, d2 = (np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return xs, ys, turn, d1, d2


def describe(pixels: np.ndarray | None) -> list[tuple[float, float, int, float, int, int]]:
    """(x, y, level, direction, first half, second half of the tests) of an image's corners, at full-scale coordinates.

    A patch must fit a level, so an image of up to 33 pixels a side has no corners.
    """
    out: list[tuple[float, float, int, float, int, int]] = []
    for level in range(LEVELS if pixels is not None else 0):
        scale = STEP**level
        height, width = round(pixels.shape[0] * scale), round(pixels.shape[1] * scale)
        if min(height, width) <= 2 * PATCH + 3:
            break
        xs, ys, turn, d1, d2 = _level(pixels if not level else _resized(pixels, height, width))
        out += zip((xs / scale).tolist(), (ys / scale).tolist(), [level] * len(xs), turn.tolist(), d1.tolist(), d2.tolist())
    return out


#: Bits of a reference for an image's place in its task, and for the corner's number; the task's number is above them.
_ROW_BITS, _CORNER_BITS = 28, 18


def _image(ref: str) -> Column:
    """The number of a reference's image."""
    return F.shiftright(ref, _CORNER_BITS)


def descriptors(images: DataFrame) -> DataFrame:
    """(ref, id, x, y, level, turn, d1, d2) of the corners in (id, image); null and unreadable images have none.

    A reference is the number of the task, the image's place in it and the corner's number, so the rows are
    to be kept (a checkpoint) before references are compared.
    """

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                rows, owner = [], []
                for k, image in enumerate(part.column(1)):
                    found = describe(decode_pgm(image.as_py()))
                    first = (((task << _ROW_BITS) + n) << _CORNER_BITS) if found else 0
                    rows += [(first + c, *d) for c, d in enumerate(found)]
                    owner += [k] * len(found)
                    n += 1
                columns = list(zip(*rows)) or [()] * 7
                kinds = [pa.int64(), pa.float32(), pa.float32(), pa.int32(), pa.float32(), pa.int64(), pa.int64()]
                ref, *rest = (pa.array(c, kind) for c, kind in zip(columns, kinds))
                yield pa.RecordBatch.from_arrays([ref, part.column(0).take(pa.array(owner, pa.int64())), *rest], names=["ref", "id", "x", "y", "level", "turn", "d1", "d2"])

    return images.select(F.col("id").cast("long"), "image").mapInArrow(described, "ref long, id long, x float, y float, level int, turn float, d1 long, d2 long")


def _buckets(rows: DataFrame, *kept: str) -> DataFrame:
    """(bucket, ref) and the columns `kept`: a row for each part of each descriptor; a bucket is a part's number and bits."""
    bits = [F.shiftrightunsigned(d, 32 * k).bitwiseAND(F.lit(0xFFFFFFFF)) for d in (F.col("d1"), F.col("d2")) for k in (0, 1)]
    return rows.select("ref", *kept, F.explode(F.array(*(b + F.lit(n << 32) for n, b in enumerate(bits)))).alias("bucket"))


def _differ(a: str, b: str) -> Column:
    """Bits in which the tests of two descriptors differ; `a` and `b` are name patterns of the halves' columns."""
    return F.bit_count(F.col(a % 1).bitwiseXOR(F.col(b % 1))) + F.bit_count(F.col(a % 2).bitwiseXOR(F.col(b % 2)))


_GEOMETRY = ("x", "y", "level", "turn")


def _consensus(matched: DataFrame) -> DataFrame:
    """(a, b, matches), images by number: the most matches of two images in one bin of scale, rotation and shift, if enough.

    `matched` has (a, b), references of descriptors that match, and the geometry of both as structs a_ and
    b_. Bins of rotation and shift overlap by half, so that agreeing matches are not parted by a border.
    """
    turn, grown = F.col("a_.turn") - F.col("b_.turn"), F.pow(F.lit(STEP), F.col("b_.level") - F.col("a_.level"))
    c, s = F.cos(turn) * grown, F.sin(turn) * grown
    # counted in cells of half a bin first; then each bin is the sum of the two by two by two cells from its corner on
    votes = matched.select(
        _image("a").alias("a"), _image("b").alias("b"), F.struct("a_.x", "a_.y").alias("at"), (F.col("b_.level") - F.col("a_.level")).alias("grown"),
        F.floor(F.pmod(turn, F.lit(2 * np.pi)) / F.lit(np.pi / TURNS)).alias("t"),
        F.floor((F.col("a_.x") - (F.col("b_.x") * c - F.col("b_.y") * s)) / (BIN / 2)).alias("x"),
        F.floor((F.col("a_.y") - (F.col("b_.x") * s + F.col("b_.y") * c)) / (BIN / 2)).alias("y"),
    )
    cells = votes.groupBy("a", "b", "grown", "t", "x", "y").agg(F.count_distinct("at").alias("n"))
    corners = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip("txy", (n >> 2, n >> 1 & 1, n & 1)))) for n in range(8)))
    bins = cells.withColumn("h", F.explode(corners))
    bins = bins.groupBy("a", "b", "grown", F.pmod(F.col("t") - F.col("h.t"), F.lit(2 * TURNS)).alias("t"), (F.col("x") - F.col("h.x")).alias("x"), (F.col("y") - F.col("h.y")).alias("y"))
    return bins.agg(F.sum("n").alias("n")).groupBy("a", "b").agg(F.max("n").alias("matches")).where(F.col("matches") >= MIN_MATCHES)


def _placed(matched: DataFrame, held: DataFrame) -> DataFrame:
    """`matched` (a, b) with the geometry of both references."""
    side = lambda s: held.select(F.col("ref").alias(s), F.struct(*_GEOMETRY).alias(f"{s}_"))
    return matched.join(side("a"), "a").join(side("b"), "b")


def _matched(met: DataFrame, held: DataFrame) -> DataFrame:
    """The distinct (a, b) of `met` that differ in MAX_BITS at most."""
    side = lambda s: held.select(F.col("ref").alias(s), F.col("d1").alias(f"{s}1"), F.col("d2").alias(f"{s}2"))
    return met.distinct().join(side("a"), "a").join(side("b"), "b").where(_differ("a%d", "b%d") <= MAX_BITS).select("a", "b")


def _left_apart(crowded: DataFrame, held: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b), a > b: matching references in one bucket of `crowded` (bucket, ref, b) whose images are in different components.

    `crowded` has each row of a bucket but its first, b. A bucket of two rows is left out: the first round
    has compared them. In each other bucket, the rows outside its largest component are queries against
    all its rows. Both sides are dealt by a hash into units of bounded size, so a large bucket is many
    units in many tasks.
    """
    sizes = crowded.groupBy("bucket", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = crowded.select("bucket", "ref").join(sizes.select("bucket"), "bucket").unionByName(sizes.select("bucket", F.col("b").alias("ref")))
    members = members.withColumn("node", _image("ref")).join(groups, "node", "left").select("bucket", "ref", F.coalesce("component", "node").alias("component"))
    members = checkpointed(members)
    parts = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"))
    main = parts.groupBy("bucket").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("c")).where("top.c < c")
    main = main.select("bucket", F.col("top.component").alias("main"), F.ceil((F.col("c") - F.col("top.c")) / UNIT_ROWS).alias("q_units"), F.ceil(F.col("c") / (2 * UNIT_ROWS)).alias("m_units"))
    rows = members.join(main, "bucket").join(held.select("ref", "d1", "d2"), "ref")
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda n, salt: F.pmod(F.xxhash64("ref", F.lit(salt)), F.col(n))
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("ref", "component", "d1", "d2")]
    asked = rows.where("component <> main").select("bucket", *side("q"), dealt("q_units", "q").alias("q"), up_to("m_units").alias("m"))
    others = rows.select("bucket", *side("m"), dealt("m_units", "m").alias("m"), up_to("q_units").alias("q"))
    same_unit = [F.col(f"q.{k}") == F.col(f"m.{k}") for k in ("bucket", "q", "m")]
    met = asked.alias("q").join(others.alias("m"), [*same_unit, F.col("q_component") != F.col("m_component"), _differ("q_d%d", "m_d%d") <= MAX_BITS])
    return met.select(F.greatest("q_ref", "m_ref").alias("a"), F.least("q_ref", "m_ref").alias("b"))


def _answers(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b, matches) of the images of `asked` and those of `held` that are copies."""
    if asked.count() <= BROADCAST_ROWS:  # held descriptors are compared where they are
        side = lambda rows, s: _buckets(rows, *_GEOMETRY, "d1", "d2").select("bucket", F.col("ref").alias(s), F.struct(*_GEOMETRY).alias(f"{s}_"), F.col("d1").alias(f"{s}1"), F.col("d2").alias(f"{s}2"))
        met = side(held, "b").join(F.broadcast(side(asked, "a")), "bucket").where(_differ("a%d", "b%d") <= MAX_BITS)
        return _consensus(met.select("a", "b", "a_", "b_"))
    met = _buckets(asked).withColumnRenamed("ref", "a").join(_buckets(held).withColumnRenamed("ref", "b"), "bucket").select("a", "b").distinct()
    side = lambda rows, s: rows.select(F.col("ref").alias(s), F.struct(*_GEOMETRY).alias(f"{s}_"), F.col("d1").alias(f"{s}1"), F.col("d2").alias(f"{s}2"))
    return _consensus(met.join(side(asked, "a"), "a").join(side(held, "b"), "b").where(_differ("a%d", "b%d") <= MAX_BITS).select("a", "b", "a_", "b_"))


def find_copies(images: DataFrame, queries: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Classes of `images` (id, image), and what each of `queries` (id, image) is a copy of.

    Returns (id, class_id, twins) of every image with an id - class_id: the smallest id among its copies;
    twins: how many images have the very same bytes - and (id, class_id, matches) of the best class of
    each query that has one, the smallest of equally good ones. A null image is alone in its class. Rows
    without an id are left out; of rows of one id, each distinct image is looked at.
    """
    null = F.concat(F.lit("null "), F.col("id").cast("string"))
    rows = images.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), "image", F.when(F.col("image").isNull(), null).otherwise(F.sha2("image", 256)).alias("digest"))
    same = checkpointed(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("twins")))
    one_each = rows.join(same.select("digest", F.col("first").alias("id")), ["digest", "id"]).dropDuplicates(["id", "digest"])
    held = checkpointed(descriptors(one_each))
    ids = checkpointed(held.select(_image("ref").alias("number"), "id").distinct())
    # both readers of a bucket's rows share one shuffle
    dealt = _buckets(held).repartition("bucket")
    first = dealt.groupBy("bucket").agg(F.min("ref").alias("b"), F.max("ref").alias("high")).where(_image("b") < _image("high")).select("bucket", "b")
    crowded = checkpointed(dealt.join(first, "bucket").where("ref <> b").select("bucket", "ref", "b"))
    led = crowded.where(_image("ref") != _image("b")).select(F.col("ref").alias("a"), "b")
    led = checkpointed(_matched(led, held))
    links = checkpointed(_consensus(_placed(led, held)).select("a", "b"))
    groups = components(links)
    # a pair's votes count in full: its matches of the first round stand beside those of the second
    apart = checkpointed(_left_apart(crowded, held, groups).distinct())
    pairs = apart.select(_image("a").alias("a_image"), _image("b").alias("b_image")).distinct()
    of_pair = led.withColumns({"a_image": _image("a"), "b_image": _image("b")}).join(pairs, ["a_image", "b_image"], "left_semi").select("a", "b")
    more = checkpointed(_consensus(_placed(apart.unionByName(of_pair).distinct(), held)).select("a", "b"))
    if not more.isEmpty():
        links = links.unionByName(more)
    named = links.join(ids.select(F.col("number").alias("a"), F.col("id").alias("a_id")), "a").join(ids.select(F.col("number").alias("b"), F.col("id").alias("b_id")), "b")
    groups = components(named, "a_id", "b_id")  # an id may name several images
    classes = same.join(groups.withColumnRenamed("node", "first"), "first", "left").select("digest", "first", "twins", F.coalesce("component", "first").alias("class_id"))
    classes = checkpointed(classes)
    found = rows.select("id", "digest").join(classes.drop("first"), "digest").select("id", "class_id", "twins")
    if queries is None:
        return found, None
    asked = checkpointed(descriptors(queries.where("id IS NOT NULL")))
    asker = asked.select(_image("ref").alias("a"), "id").distinct()
    of_class = _answers(asked, held).join(ids.select(F.col("number").alias("b"), F.col("id").alias("first")), "b").join(classes.select("first", "class_id").distinct(), "first")
    best = of_class.join(asker, "a").groupBy("id").agg(F.max(F.struct("matches", F.bitwise_not("class_id").alias("c"))).alias("best"))
    return found, best.select("id", F.bitwise_not("best.c").alias("class_id"), F.col("best.matches").alias("matches"))


# ---- the query's images

SIDE = 96
_WAVES = 64


def _waves() -> np.ndarray:
    """A plane wave for each of _WAVES components, 7 to 16 pixels long, in all directions."""
    k = np.arange(_WAVES)
    turn, length = k * 2.399963, 7 + 9 * (k * 0.618034 % 1)
    y, x = np.mgrid[:SIDE, :SIDE]
    return np.cos(2 * np.pi * (np.cos(turn)[:, None, None] * x + np.sin(turn)[:, None, None] * y) / length[:, None, None] + k[:, None, None]).reshape(_WAVES, -1).astype(np.float32)


def picture(vector: list[float] | None) -> bytes | None:
    """A grey texture of a vector: waves weighted by its components (component k to wave k modulo their number)."""
    if not vector:
        return None
    weight = np.bincount(np.arange(len(vector)) % _WAVES, weights=np.nan_to_num(np.asarray(vector, float)), minlength=_WAVES).astype(np.float32)
    texture = weight @ _BASIS
    return encode_pgm(np.clip(texture / (float(texture.std()) or 1.0) * 50 + 128, 0, 255).reshape(SIDE, SIDE))


_BASIS = _waves()


def edited(image: bytes | None, number: int) -> bytes | None:
    """A copy, a little darker, that is cropped to four fifths, turned by a quarter for every other number, and for every third one resized by a step of the pyramid instead of cropped."""
    pixels = decode_pgm(image)
    if pixels is None:
        return None
    turn, cut, at = number // 50, SIDE * 4 // 5, number // 50 % (SIDE // 5)
    pixels = (_resized(pixels, round(SIDE * STEP), round(SIDE * STEP)) if turn % 3 == 2 else pixels[at : at + cut, SIDE // 5 - at :][:, :cut]) * 0.9 + 4
    return encode_pgm(np.rot90(pixels) if turn % 2 else pixels)


def op4_media(spark, sf_dir):
    """Every vector's picture and its class; every 50th picture also comes back edited, as a query against all."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")

    def drawn(edit: bool):
        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, 500):
                    part = batch.slice(low, 500)
                    ids = part.column(0).to_pylist()
                    images = [picture(v) for v in part.column(1).to_pylist()]
                    if edit:
                        images = [edited(image, n or 0) for image, n in zip(images, ids)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(images, pa.binary())], names=["id", "image"])

        return draw

    images = vectors.mapInArrow(drawn(False), "id long, image binary")
    queries = vectors.where(F.col("vec_id") % 50 == 0).mapInArrow(drawn(True), "id long, image binary")
    classes, answers = find_copies(images, queries)
    answers = answers.select("id", F.col("class_id").alias("edited_class_id"), F.col("matches").alias("edited_matches"))
    return classes.join(answers, "id", "left").select(F.col("id").alias("vec_id"), "class_id", "twins", (F.col("id") % 50 == 0).alias("is_query"), "edited_class_id", "edited_matches")
