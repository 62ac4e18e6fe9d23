"""Every query against its SQL."""

import zlib

import pytest

import __spark_entry__ as entry
from plumbline import queries as engine
from tests.oracle import SMALL, check


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_query_and_sql_agree(spark, name):
    check(spark, engine.QUERIES[name], engine.SQL[name], "/root/testdata/sf0.01")


def test_queries_without_sql_run(spark):
    for name in sorted(engine.QUERIES.keys() - engine.SQL.keys()):
        assert engine.QUERIES[name](spark, SMALL).count() > 0


def test_checksums(spark):
    names = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{SMALL}/part.parquet").collect()}
    assert {r.p_partkey: r.crc for r in engine.QUERIES["crc32"](spark, SMALL).collect()} == {k: zlib.crc32(n.encode()) for k, n in names.items()}
    assert spark.sql("SELECT crc32('123456789')").first()[0] == 3421780262


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.score >= 0.85 for r in rows)


def test_every_sql_has_its_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
