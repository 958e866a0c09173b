"""Every query with SQL gives the same rows and types as DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from gridloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events pages embeddings".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    types = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: TYPES[t] for c, t in got.dtypes} == types
    at = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=_key)
    others = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=_key)
    assert len(rows) == len(others)
    for a, b in zip(rows, others, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9), (name, a, b)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
