"""Scalar functions and numbered rows against plain Python."""

import random
import time

from pyspark.sql import functions as F

from plumbline.functions import scalars
from plumbline.operators import relational


def test_field_and_its_other_stop_characters(spark):
    df = spark.createDataFrame([('{"tags": [1, 2], "n": 3}',), ("n:4;x",), ("none",), (None,)], "v string")
    got = [tuple(r) for r in df.select(scalars.field(F.col("v"), "n"), scalars.field(F.col("v"), "n", ",;}]"), scalars.field(F.col("v"), "tags", ",;}]")).collect()]
    assert got[:2] == [("3", "3", "[1"), ("4", "4", None)] and got[3] == (None, None, None)


def test_time_in_microseconds(spark):
    before = time.time()
    now = spark.range(1).select(scalars.now_micros()).first()[0]
    assert before - 1 <= now / 1e6 <= time.time() + 1


def test_positions_over_many_ranges(spark):
    r = random.Random(2)
    rows = [(r.randrange(10**6), f"v{k}") for k in range(5000)]
    for reverse in (False, True):
        order = F.desc("k") if reverse else F.asc("k")
        got = relational.positions(spark.createDataFrame(rows, "k long, `v.w` string").repartition(7), order, F.col("`v.w`").asc()).collect()
        assert [x.k for x in sorted(got, key=lambda x: x.pos)] == sorted((k for k, _ in rows), reverse=reverse)
        assert sorted(x.pos for x in got) == list(range(1, 5001))
    assert relational.positions(spark.range(0), F.col("id")).count() == 0
