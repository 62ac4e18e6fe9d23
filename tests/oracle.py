"""Runs a query and its SQL over the same tables, and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def check(spark, build, sql, sf_dir=SMALL):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(sql)
    expected = _rows([d[0] for d in want.description], want.fetchall())
    df = build(spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == expected[0]
    assert got[1] == expected[1]
    assert expected[1] or sf_dir == SMALL
