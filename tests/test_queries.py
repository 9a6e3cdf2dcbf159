"""Every registered query of the library's own functions against its SQL, on the small tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from geolith.plans import queries as spatial

SF = "/root/testdata/sf0.001"
SLOW = {"bench_intersects"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(set(spatial.queries()) - SLOW))
def test_query(name, spark, duck):
    frame = spatial.queries()[name](spark, SF)
    got = duck.execute(spatial.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(frame.columns) == sorted(names)
    rows = sorted((tuple(plain(v) for v in r) for r in frame.select(*names).collect()), key=repr)
    assert rows == sorted((tuple(plain(v) for v in r) for r in got.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25
    assert set(spatial.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
