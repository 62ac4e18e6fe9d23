"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are dealt into blocks. With u of a period's P slots for a source, its block j has
release time floor(j P / u) and deadline ceil((j + 1) P / u); in each slot the released block with the
earliest deadline goes next. As the units u add up to P, no deadline is missed, and at every slot each
source is less than one block from its target share, until the first source has run out. Slots of a source
that has run out stay empty. Everything is a DataFrame expression; the schedule, a row a slot, is a fold
over an array in one task, as long as the period or the run, whichever is shorter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed, table

#: Documents of a block; documents ranked together when blocks are numbered; such buckets summed up together.
BLOCK_ROWS, BUCKET_ROWS, BUCKETS = 64, 4096, 1024
#: A target weight is the source's share of documents to this power, unless weights are given; it is rounded
#: to whole units, of which there are this many or this many a source, whichever is more.
TEMPERATURE, UNITS, UNITS_A_SOURCE = 0.5, 1000, 20
#: Units of a given weight of 1: weights of up to nine decimals are met exactly. Units of a period at most, so
#: that its square is a long; larger given weights are brought to parts in GIVEN_UNITS of their sum.
GIVEN_UNITS, MAX_PERIOD = 10**9, 3 * 10**9
#: Slots that one inner fold schedules.
_SEGMENT = 512
#: Rows of sources or of the schedule that are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000

_NONE = "\u0000"


def _times(turn: Column, units: Column, period: int) -> tuple[Column, Column]:
    """Release time and deadline of a block in its period, in whole numbers throughout."""
    p = F.lit(period).cast("long")
    return F.call_function("div", turn * p, units), F.call_function("div", (turn + 1) * p + units - 1, units)


def _next_block(who: Column, units: Column, turn: Column, period: int) -> Column:
    """The block `turn` of a source, in the order in which ready blocks are taken."""
    release, deadline = _times(turn, units, period)
    return F.struct(deadline.alias("deadline"), who.alias("who"), turn.alias("turn"), release.alias("release"), units.alias("units"))


def _slots(pools: DataFrame, period: int, slots: int) -> DataFrame:
    """(source, turn, slot) of the first `slots` slots of the earliest-deadline-first schedule of (source, units)."""
    one = pools.groupBy().agg(F.sort_array(F.collect_list(F.struct("source", "units"))).alias("s"))  # a row of small structs, one a source
    fresh = F.transform("s", lambda x, i: _next_block(i, x["units"], F.lit(0).cast("long"), period))
    kind = "array<array<struct<slot:bigint,who:int,turn:bigint>>>"

    # a lambda over one element is what makes Spark work out a value once that is used more than once
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)

    def step(state: Column, slot: Column) -> Column:
        def after(best: Column) -> Column:
            following = F.transform(state["ready"], lambda x: F.when(x["who"] == best["who"], _next_block(x["who"], x["units"], x["turn"] + 1, period)).otherwise(x))
            chosen = F.struct(slot.alias("slot"), best["who"].alias("who"), best["turn"].alias("turn"))
            return F.struct(following.alias("ready"), F.concat(state["picked"], F.array(chosen)).alias("picked"))

        return once(F.array_min(F.filter(state["ready"], lambda x: x["release"] <= slot)), after)

    def segment(state: Column, number: Column) -> Column:
        low = number * _SEGMENT
        inside = F.sequence(low, F.least(low + (_SEGMENT - 1), F.lit(slots - 1).cast("long")))
        part = F.aggregate(inside, F.struct(state["ready"].alias("ready"), F.array().cast(kind[6:-1]).alias("picked")), step)
        return once(part, lambda p: F.struct(p["ready"].alias("ready"), F.concat(state["picked"], F.array(p["picked"])).alias("picked")))

    segments = F.sequence(F.lit(0).cast("long"), F.lit((slots - 1) // _SEGMENT).cast("long"))
    folded = F.aggregate(segments, F.struct(fresh.alias("ready"), F.array().cast(kind).alias("picked")), segment)["picked"]
    picked = one.select("s", F.explode(F.flatten(folded)).alias("p"))
    return picked.select(F.element_at("s", F.col("p.who") + 1)["source"].alias("source"), F.col("p.turn").alias("turn"), F.col("p.slot").alias("slot"))


def _ranked(docs: DataFrame, pools: DataFrame, small: bool) -> DataFrame:
    """(row, source, rank) and the columns of `pools`: each row of `docs`, as one struct, with its place among its source's."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.withColumn("source", F.coalesce(F.col("row.source").cast("string"), F.lit(_NONE)))
    rows = rows.join(F.broadcast(pools) if small else pools, "source")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row.doc_id"), F.ceil(F.col("n") / BUCKET_ROWS)))
    # the rank in the bucket, plus the rows in the source's buckets before it, summed up in two steps
    counted = rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("c")).withColumn("shelf", F.floor(F.col("bucket") / BUCKETS))
    shelves = counted.groupBy("source", "shelf").agg(F.sum("c").alias("c"))
    until = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda *keys: F.coalesce(F.sum("c").over(until(*keys)), F.lit(0))
    shelves = shelves.select("source", "shelf", before("source", "shelf").alias("below"))
    offsets = counted.select("source", "shelf", "bucket", before("source", "shelf", "bucket").alias("offset")).join(shelves, ["source", "shelf"])
    offsets = offsets.select("source", "bucket", (F.col("offset") + F.col("below")).alias("offset"))
    place = F.row_number().over(Window.partitionBy("source", "bucket").orderBy(F.xxhash64("row.doc_id", F.lit("place")), "row.doc_id"))
    return rows.withColumn("place", place).join(offsets, ["source", "bucket"]).withColumn("rank", F.col("offset") + F.col("place") - 1)


def _given_units(weights: dict[str, float]) -> dict[str, int]:
    units = {s: round(w * GIVEN_UNITS) for s, w in weights.items()}
    units = {s: u // math.gcd(*units.values()) for s, u in units.items() if u > 0}
    if sum(units.values()) <= MAX_PERIOD:
        return units
    every = sum(w for w in weights.values() if w > 0)
    return {s: max(1, round(w / every * GIVEN_UNITS)) for s, w in weights.items() if w > 0}


def _placed(docs: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """(row, block, release, deadline, slot, position); see `schedule`."""
    name = F.coalesce(F.col("source").cast("string"), F.lit(_NONE))
    sizes = docs.groupBy(name.alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        root = F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE))
        total = F.sum(root).over(Window.partitionBy())  # a row a source
        grid = F.greatest(F.lit(UNITS), F.lit(UNITS_A_SOURCE) * F.count(F.lit(1)).over(Window.partitionBy()))
        pools = sizes.select("source", "n", F.greatest(F.lit(1), F.round(root / total * grid)).cast("long").alias("units"))
    else:
        given = sizes.sparkSession.createDataFrame(sorted(_given_units(weights).items()), "source string, units long")
        pools = sizes.join(given, "source", "left").select("source", "n", F.coalesce("units", F.lit(0)).alias("units"))
    pools = checkpointed(pools)
    period, known = pools.agg(F.sum("units"), F.count(F.lit(1))).first()
    ranked = _ranked(docs, pools, known <= BROADCAST_ROWS).withColumn("block", F.floor(F.col("rank") / BLOCK_ROWS))
    turn_of = lambda block: (F.call_function("div", block, F.col("units")), block % F.col("units"))
    if not period:  # no row or no weight
        period, run, plan = 1, 0, sizes.sparkSession.createDataFrame([], "source string, turn long, slot long")
    else:
        since, turn = turn_of(F.ceil(F.col("n") / BLOCK_ROWS).cast("long") - 1)
        run = pools.where("units > 0").agg(F.max(since * F.lit(period) + _times(turn, F.col("units"), period)[1])).first()[0]
        plan = _slots(pools.where("units > 0").select("source", "units"), period, min(period, run))
    # a source without weight follows after the last slot, a block of each in turn
    idle = pools.where("units = 0").select("source", (F.row_number().over(Window.orderBy("source")) - 1).alias("nth"), F.count(F.lit(1)).over(Window.partitionBy()).alias("idle"))
    weighted = F.col("units") > 0
    since, turn = turn_of(F.col("block"))
    ranked = ranked.withColumn("since", F.when(weighted, since * F.lit(period))).withColumn("turn", F.when(weighted, turn))
    hint = lambda df, rows: F.broadcast(df) if rows <= BROADCAST_ROWS else df
    out = ranked.join(hint(plan, min(period, run)), ["source", "turn"], "left").join(hint(idle, known), "source", "left")
    release, deadline = _times(F.col("turn"), F.col("units"), period)
    timed = out.select(
        "row", "rank", "block",
        (F.col("since") + F.when(weighted, release)).alias("release"),
        (F.col("since") + F.when(weighted, deadline)).alias("deadline"),
        F.when(weighted, F.col("since") + F.col("slot")).otherwise(F.lit(run) + F.col("block") * F.col("idle") + F.col("nth")).alias("slot"),
    )
    return timed.select("row", "block", "release", "deadline", "slot", (F.col("slot") * BLOCK_ROWS + F.col("rank") % BLOCK_ROWS).alias("position"))


def schedule(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """`docs` with block, release, deadline, slot and position after its own columns (replaced if there).

    Every row comes back once. A null source is a source of its own, named by the character 0. `weights`
    gives target weights by source, to nine decimals; sources of weight 0 or without one come after all
    others, with null release and deadline. Without `weights` they follow TEMPERATURE. Documents of a source
    are blocked in the order of a hash of their id, so rows of equal id may share a block in any order.
    position = slot * BLOCK_ROWS + place in the block: unique, ascending along the mix, with gaps where a
    block is short or a source has run out. The fold takes slots times sources steps in one task.
    """
    added = ["block", "release", "deadline", "slot", "position"]
    docs = docs.drop(*added)
    return _placed(docs, weights).select(*(F.col("row").getField(c).alias(c) for c in docs.columns), *added)


def mix(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The same rows and columns in the order of the schedule: files and rows in files follow the mix."""
    placed = _placed(docs, weights).select("row", "position")
    return placed.repartitionByRange("position").sortWithinPartitions("position").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op5_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return schedule(docs)
