"""op3 against all pairs by Python sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from duplexa.llm import ngram_join as J

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_shingles", T.StringType()), T.StructField("key", T.StringType())])


def sets_of(text):
    w = WORD.findall((text or "").encode().lower())
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows):
    s = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i, x in enumerate(s):
        if rows[i][0] is not None:
            for g in x:
                where.setdefault(g, []).append(i)
    near = {(i, j) for v in where.values() for i in v for j in v if i < j}
    for i, j in near:
        inter = len(s[i] & s[j])
        if 100 * inter >= 80 * len(s[i] | s[j]):
            parent[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(k, low.get(find(i), k))
    return sorted(((k, len(s[i]), None if k is None else low[find(i)]) for i, (k, _) in enumerate(rows)), key=str)


def planted():
    r = random.Random(5)
    word = lambda: f"{r.choice('abcdefgh')}{r.randrange(60)}"
    rows = [(i, " ".join(word() for _ in range(r.randrange(60)))) for i in range(60)]
    passage = " ".join(word() for _ in range(40))
    for base in [" ".join(word() for _ in range(n)) for n in (30, 80, 200, 9)]:
        for _ in range(25):
            w = base.split()
            for _ in range(r.randrange(5)):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows), r.choice([" ", "\n"]).join(w).upper() if r.random() < 0.3 else " ".join(w)))
    rows += [(len(rows) + i, passage + " " + " ".join(word() for _ in range(r.randrange(120)))) for i in range(40)]
    rows += [(900 - i, rows[70][1]) for i in range(20)]
    rows += [(901, None), (902, ""), (903, " \n"), (904, "one two"), (905, "One  TWO"), (906, "one two three"), (None, rows[70][1]), (None, None), (5, rows[61][1]), (5, rows[5][1]), (907, "É é"), (908, "é é")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("lists,blocks", [(20_000, 4096), (3, 4)])
def test_matches_brute_force(spark, lists, blocks):
    rows = planted()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    assert sorted(map(tuple, J.join(df, buckets=3, list_rows=lists, block_rows=blocks).collect()), key=str) == brute(rows)


def test_bitmaps_never_part_a_link():
    """Sets that link are never told apart, whatever their widths; most of those far apart are."""
    r = np.random.default_rng(3)
    parted = 0
    for _ in range(300):
        n = int(r.choice([1, 2, 5, 9, 60, 130, 700, 4100]))
        base = np.unique(r.integers(0, 1 << 63, n * 2, dtype=np.uint64))
        other = np.unique(np.concatenate([base[: int(len(base) * r.uniform(0.6, 1))], r.integers(0, 1 << 63, int(n * r.uniform(0, 0.4)), dtype=np.uint64)]))
        sizes = np.array([len(base), len(other)])
        maps, begin = J.bitmaps(np.concatenate([base, other]), np.array([0, len(base), len(base) + len(other)]))
        apart = J._apart(np.array([0]), np.array([1]), sizes, [maps[a:b].view(np.uint64) for a, b in zip(begin, begin[1:])])[0]
        linked = 100 * len(np.intersect1d(base, other)) >= 80 * len(np.union1d(base, other))
        assert not (apart and linked)
        parted += apart
    assert parted > 50


def test_long_texts(spark):
    """Texts of more than a slice, with and without a link."""
    r = random.Random(1)
    words = [f"w{r.randrange(1 << 40)}" for _ in range(90_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:85_000])), (3, " ".join(words[:60_000])), (4, "x"), (5, " ".join(words[:30_000]) + " " + " ".join(reversed(words)))]
    got = {x[0]: x[1:] for x in map(tuple, J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())}
    assert {k: v[1] for k, v in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5} and got[1][0] == 89_996


def test_components(spark):
    """Stars, chains, loops, null ends and repeated edges against union-find; the root is the smallest node."""
    from duplexa.llm._graph import components

    r = random.Random(4)
    edges = [(7, i) for i in range(100, 160)] + [(i, i + 1) for i in range(200, 230)] + [(5, 5), (None, 9), (9, None), (300, 7), (7, 300)]
    edges += [(r.randrange(400, 500), r.randrange(400, 500)) for _ in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {(x["node"], x["root"]) for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, find(x)) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(spark):
    assert J.join(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in J.join(spark.createDataFrame([(1, None, None, None)], SCHEMA)).collect()] == [(1, 0, 1)]


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, J.op3_ngram_join(spark, d).collect())) == sorted(brute(rows))
