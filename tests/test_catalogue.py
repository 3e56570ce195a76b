"""Every registered query of the library's own operators against DuckDB, on whole tables of sf0.001."""

import math
import os

import duckdb
import pytest

from docmill.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return "NULL" if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    if name not in ORACLE:
        assert got
        return
    rel = duck.sql(ORACLE[name])
    cols = list(rel.columns)
    assert sorted(cols) == names
    assert got == sorted(tuple(plain(dict(zip(cols, row, strict=True))[c]) for c in names) for row in rel.fetchall())
