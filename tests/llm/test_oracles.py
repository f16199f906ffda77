"""The corpus queries that have SQL, against DuckDB."""

import duckdb
import pytest

from duplexa.llm import queries as Q

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    answer = con.execute(Q.oracle_sql()[name])
    names = [c[0] for c in answer.description]
    want = sorted(answer.fetchall(), key=str)
    got = Q.queries()[name](spark, D)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == want
