"""Every query with SQL against DuckDB on the small tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from orbweave import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(str(float(r[k]) + 0.0) if isinstance(r[k], (int, float)) and not isinstance(r[k], bool) else str(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    got = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(rows, df.columns) == plain(got.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_has_finite_rows(spark, name):
    rows = catalog.QUERIES[name](spark, SF).collect()
    assert rows
    assert all(math.isfinite(v) for r in rows for v in r if isinstance(v, float))
