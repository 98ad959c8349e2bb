"""Every query of the catalog that has SQL agrees with DuckDB on the smallest tables; the entry runs without text queries."""

import math
import os

import duckdb
import pytest

from rasterlake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [sorted(names)] + sorted([cell(float(r[i])) if isinstance(r[i], float) else cell(r[i]) for i in order] for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_duckdb(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.SQL[name])
    assert table_of(got.columns, [tuple(r) for r in got.collect()]) == table_of([d[0] for d in want.description], want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
