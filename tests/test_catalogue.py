"""Every query of the catalogue against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from duplexa.plans.catalogue import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events".split()
D = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def plain(x):
    return x if not isinstance(x, float) else "nan" if math.isnan(x) else round(x, 9)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, D)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(x) for x in r) for r in got.select(*columns).collect()), key=str)
    if name not in SQL:
        assert rows
        return
    answer = duck.execute(SQL[name])
    names = [c[0] for c in answer.description]
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall()]
    assert sorted(names) == columns
    assert rows == sorted(want, key=str)
