"""Neighbours and items by blocks against plain loops, with blocks, slices and packs so small that all cuts occur."""

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from duplexa.operators import blocks, recommend


def similarity(both, one, two, total):
    x = lambda v: v * math.log(v) if v > 0 else 0.0
    a, b, c, d = both, two - both, one - both, total - one - two + both
    llr = max(0.0, 2 * (x(a) + x(b) + x(c) + x(d) - x(a + b) - x(c + d) - x(a + c) - x(b + d) + x(a + b + c + d)))
    return 1 - 1 / (1 + llr)


def similarities(baskets, least):
    """Of the things in the baskets: {x: {y: similarity}}."""
    degree, both = defaultdict(int), defaultdict(int)
    for basket in baskets.values():
        for x in basket:
            degree[x] += 1
            for y in basket:
                if x < y:
                    both[x, y] += 1
    out = defaultdict(dict)
    for (x, y), n in both.items():
        if n >= least:
            out[x][y] = out[y][x] = similarity(n, degree[x], degree[y], len(baskets))
    return out


def turned(baskets):
    out = defaultdict(set)
    for k, basket in baskets.items():
        for x in basket:
            out[x].add(k)
    return out


def top(scores, n):
    return [(y, round(s, 6)) for y, s in sorted(scores.items(), key=lambda v: (-round(v[1], 6), v[0]))[:n]]


@pytest.fixture(scope="module")
def baskets():
    r = np.random.default_rng(3)
    out = {int(u) * 7 - 40: {int(i) for i in r.zipf(1.4, 12) % 90 + (1 << 40) * (u % 2)} for u in range(120)}  # negative ids, ids over 32 bits
    out[5000] = {int(i) for i in range(90)}  # a heavy user; item 1 is hot anyway
    return out


@pytest.fixture(params=[False, True])
def small(request, monkeypatch):
    if request.param:
        for name, value in {"BLOCK": 50, "PACKED": 20, "SLICE": 60, "HELD": 500, "LEAST": 3}.items():
            monkeypatch.setattr(blocks, name, value)


def edges(spark, baskets):
    rows = [(u, i) for u, items in baskets.items() for i in items]
    return spark.createDataFrame(rows + rows[:50] + [(None, 1), (3, None)], "user bigint, item bigint")


@pytest.mark.parametrize("least", [1, 2])
def test_items(spark, baskets, small, least):
    similar, want = similarities(baskets, least), {}
    for u, items in baskets.items():
        scores = defaultdict(float)
        for i in items:
            for j, s in similar[i].items():
                if j not in items:
                    scores[j] += s
        want |= {(u, k): v for k, v in enumerate(top(scores, 10), 1)}
    got = recommend.item_based(edges(spark, baskets), 10, least).collect()
    assert {(r["user"], r["rank"]): (r["item"], r["score"]) for r in got} == want


@pytest.mark.parametrize("least", [1, 2])
def test_users(spark, baskets, small, least):
    near = {x: sorted(ys.items(), key=lambda v: (-round(v[1], 9), v[0]))[:8] for x, ys in similarities(turned(baskets), least).items()}
    got = recommend.user_neighbours(edges(spark, baskets), 8, least).collect()
    assert {(r["x"], r["place"]): (r["y"], round(r["similarity"], 9)) for r in got} == {(x, k): (y, round(s, 9)) for x, ys in near.items() for k, (y, s) in enumerate(ys, 1)}
    want = {}
    for x, ys in near.items():
        scores = defaultdict(float)
        for y, s in ys:
            for i in baskets[y] - baskets[x]:
                scores[i] += s
        want |= {(x, k): v for k, v in enumerate(top(scores, 10), 1)}
    got = recommend.user_based(edges(spark, baskets), 10, 8, least).collect()
    assert {(r["user"], r["rank"]): (r["item"], r["score"]) for r in got} == want


def test_pairs_are_not_shuffled(spark):
    """One item that all 3,000 users have: nine million pairs, and a shuffle of rows for edges and blocks only."""
    rows = spark.range(3000).selectExpr("id AS user", "0L AS item").unionByName(spark.range(3000).selectExpr("id AS user", "id % 7 + 1 AS item"))
    found = recommend.user_neighbours(rows, 5)
    assert found.count() == 15_000
    plan = found._jdf.queryExecution().toString()
    assert "SortMergeJoin [user" not in plan and "Window" not in plan


def test_empty(spark):
    none = spark.createDataFrame([], "user bigint, item bigint")
    assert recommend.user_based(none).count() == recommend.item_based(none).count() == recommend.user_neighbours(none).count() == 0


def copies(baskets, n, users, items):
    """Graphs that share nothing, with shifted keys."""
    return {u + k * users: {i + k * items for i in basket} for u, basket in baskets.items() for k in range(n)}


def recommended(baskets, least=1):
    similar, want = similarities(baskets, least), {}
    for u, items in baskets.items():
        scores = defaultdict(float)
        for i in items:
            for j, s in similar[i].items():
                if j not in items:
                    scores[j] += s
        want |= {(u, k): v for k, v in enumerate(top(scores, 10), 1)}
    return want


@pytest.mark.parametrize("share, cells", [(0, 1 << 20), (0, 700), (2, 1 << 20)])
def test_items_by_tables_and_one_by_one(spark, monkeypatch, share, cells):
    """Tables, halved tables, and no tables; more pairs than different arguments; users with more rows than are added at a time."""
    monkeypatch.setattr(blocks, "SHARE", share)
    monkeypatch.setattr(blocks, "CELLS", cells)
    r = np.random.default_rng(5)
    one = {u: {int(i) for i in r.integers(0, 300, 15)} for u in range(100)} | {100: set(range(200)), 101: set(range(50, 300)), 102: {7}}
    baskets = copies(one, 3, 1000, 2000)
    for slice_, held in ((1 << 18, 6_000_000), (3000, 9000)):
        monkeypatch.setattr(blocks, "SLICE", slice_)
        monkeypatch.setattr(blocks, "HELD", held)
        got = recommend.item_based(edges(spark, baskets), 10, 1).where("item is not null").collect()
        assert {(x["user"], x["rank"]): (x["item"], x["score"]) for x in got} == recommended({**baskets, 3: baskets[3]})


def test_similarities_with_few_arguments():
    """More pairs than different arguments: each is computed once, and goes to all its pairs."""
    r = np.random.default_rng(2)
    both, one, two = r.integers(1, 3, 5000), r.integers(3, 9, 5000), r.integers(3, 9, 5000)
    got = blocks._similarity(both, one, two, 100)
    assert got.tolist() == pytest.approx([similarity(int(a), int(b), int(c), 100) for a, b, c in zip(both, one, two, strict=True)], abs=1e-12)


def test_baskets_go_where_they_matter(spark, monkeypatch):
    """Twelve graphs that share nothing: a basket goes to few blocks, not to all, so the work grows with the edges."""

    def counted(run, *names):
        def go(batches):
            for batch in batches:
                for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([len(blocks._unpack(blob.as_buffer())[0])]), pa.array([0.0])], names=list(names))

        return go

    r = np.random.default_rng(4)
    one = {u: {int(i) for i in r.integers(0, 60, 8)} for u in range(50)}
    baskets = copies(one, 12, 1000, 1000)
    rows = spark.createDataFrame([(u, i) for u, items in baskets.items() for i in items], "user bigint, item bigint")
    monkeypatch.setattr(blocks, "_task", counted)
    sent = sum(x["item"] for x in recommend.item_based(rows, 1000, 1).collect())
    assert len(baskets) <= sent <= 4 * len(baskets)
