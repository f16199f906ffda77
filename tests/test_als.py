"""Lists of the matrix-factorisation recommender against all scores, sorted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from duplexa.operators import recommend


@pytest.mark.parametrize("implicit", [False, True])
@pytest.mark.parametrize("rounds", [1, 3])
def test_lists(spark, monkeypatch, implicit, rounds):
    r = np.random.default_rng(5)
    rows = [(u, int(i) * 3, float(r.integers(1, 50))) for u in range(70) for i in set(r.integers(0, 200, 15))] + [(99, i * 3, 1.0) for i in range(190)]  # user 99 has nearly all
    ratings = spark.createDataFrame(rows + rows[:20], "user bigint, item bigint, rating double")
    model = recommend.als(ratings, rank=4, iterations=2, implicit=implicit)
    if rounds > 1:
        monkeypatch.setattr(recommend, "FACTOR_BYTES", 200 * 4 * 4 // 2 - 16)
    monkeypatch.setattr(recommend, "TILE", 37)
    got = recommend.als_top(model, ratings, 20)
    assert got.dtypes == [("user", "bigint"), ("item", "bigint"), ("score", "float"), ("rank", "int")]
    lists = {}
    for x in got.orderBy("user", "rank").collect():
        lists.setdefault(x["user"], []).append((x["item"], x["score"], x["rank"]))
    users = {x["id"]: np.array(x["features"]) for x in model.userFactors.collect()}
    items = {x["id"]: np.array(x["features"]) for x in model.itemFactors.collect()}
    seen = {u: {i for v, i, _ in rows if v == u} for u in users}
    for u, f in users.items():
        all_ = sorted(((float(f @ g), i) for i, g in items.items() if i not in seen[u]), reverse=True)
        own = lists.get(u, [])
        assert [x[2] for x in own] == list(range(1, min(20, len(all_)) + 1))
        assert np.allclose([x[1] for x in own], [s for s, _ in all_[:20]], atol=1e-4)
        assert not seen[u] & {x[0] for x in own} and len({x[0] for x in own}) == len(own)
        assert all(abs(float(f @ items[i]) - s) < 1e-4 for i, s, _ in own)


def test_no_list_is_cut_by_long_histories(spark):
    """Users are scored once against all items; no list of n and the longest history is made."""
    ratings = spark.range(300).selectExpr("id % 10 AS user", "id % 100 AS item", "double(id % 7 + 1) AS rating")
    found = recommend.als_top(recommend.als(ratings, rank=2, iterations=1), ratings, 500)
    assert "Window" not in found._jdf.queryExecution().toString()
    assert found.groupBy("user").agg(F.count("*").alias("n")).where("n != 100 - 10").count() == 0
