"""op1 against the full cosine matrix."""

import numpy as np
import pytest
from pyspark.sql import types as T

from duplexa.llm import embedding_dedup as E

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("kept", T.StringType()), T.StructField("v", T.StringType())])


def brute(rows, threshold=0.95):
    good = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    label, links = list(range(len(rows))), [0] * len(rows)
    unit = {i: np.float32(rows[i][1]).astype(float) for i in good}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, i in enumerate(good):
        for j in good[a + 1 :]:
            if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                label[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(k, low.get(find(i), k))
    return sorted(((k, links[i], None if k is None else low[find(i)], None if k is None else k == low[find(i)]) for i, (k, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [None, 40])
def test_matches_brute_force(spark, block):
    r = np.random.default_rng(6)
    rows = []
    for _ in range(12):
        centre = r.normal(size=16)
        rows += [(centre + r.normal(size=16) * r.choice([0.02, 0.15, 0.3])).tolist() for _ in range(r.integers(1, 30))]
    rows = [(i * 3 % 1000, np.float32(v).tolist()) for i, v in enumerate(rows)]
    rows += [(2000 + i, rows[0][1]) for i in range(5)] + [(2100, [-2 * x for x in rows[0][1]]), (2101, [2 * x for x in rows[0][1]]), rows[4], rows[4]]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [None] + [1.0] * 15), (3004, [float("nan")] * 16), (3005, [float("inf")] * 16), (None, rows[0][1]), (3006, [1.0, 2.0]), (3007, [1.0, 2.0]), (3008, [1e30] * 16), (3009, [1e-30] * 16)]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    assert sorted(map(tuple, E.dedup(df, block=block).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert E.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r[0], list(r[1])) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, E.op1_embedding_dedup(spark, d).collect()), key=str) == brute(rows)
