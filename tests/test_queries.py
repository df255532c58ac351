"""Every query of the library against its SQL twin, on the small tables."""

import math
import os

import duckdb
import pytest

from tarn.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the small tables are not here")


def norm(v):
    if isinstance(v, float):
        return round(v, 7) if math.isfinite(v) else str(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows_as_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((norm(tuple(r)) for r in df.select(*columns).collect()), key=repr)
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    rel = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((norm(tuple(r[i] for i in at)) for r in rel.fetchall()), key=repr)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.entry(spark).columns) == 5
