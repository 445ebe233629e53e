"""Every query that has SQL gives the rows that a second engine gives for that SQL."""

import math

import duckdb
import pytest

from factloom.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def plain(rows):
    show = lambda v: round(v, 5) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(map(show, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf, duck, name):
    found = QUERIES[name](spark, sf)
    names = sorted(found.columns)
    got = plain(found.select(*[f"`{c}`" for c in names]).collect())
    want = plain(duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in names)} from ({ORACLE_SQL[name]})").fetchall())
    assert got == want


def test_every_query_runs(spark, sf):
    for name in sorted(set(QUERIES) - set(ORACLE_SQL)):
        assert QUERIES[name](spark, sf).count() > 0, name
