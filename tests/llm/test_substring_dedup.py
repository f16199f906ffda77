"""op10 against a brute force over Python dicts, and its edge cases."""

import hashlib
import random
import re

from pyspark.sql import types as T

from duplexa.llm.substring_dedup import COVER, PERIOD, op10_substring_dedup, remove_repeats

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.StringType())])


def brute(rows):
    words = [(i, WORD.findall((t or "").encode())) for i, t in rows]
    least = {}
    for i, w in words:
        for s in range(len(w) - 49 if i is not None else 0):
            key = tuple(w[s : s + 50])
            least[key] = min(i, least.get(key, i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - 49 if i is not None else 0):
            if least[tuple(w[s : s + 50])] < i:
                gone[s : s + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "extra") for i, t in rows], SCHEMA)
    got = remove_repeats(df, **kw).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    return sorted((tuple(r) for r in got), key=str)


def test_cover_is_perfect():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_matches_brute_force(spark):
    r = random.Random(3)
    word = lambda: r.choice("ab cd ef gh ij kl mn op".split()) + str(r.randrange(40))
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 83, 120)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(r.randrange(90))]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(w) + 1)
            w[at:at] = r.choice(shared)
        rows.append((i * 7 % 61, r.choice([" ", "\n", "\t "]).join(w)))
    rows += [(100, None), (101, ""), (None, rows[5][1]), (5, rows[5][1]), (5, rows[5][1]), (102, "x " * 300), (103, "x " * 300), (104, "é " + " ".join(shared[3]))]
    assert run(spark, rows, groups=5) == brute(rows)
    assert run(spark, rows, groups=1) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in op10_substring_dedup(spark, d).collect())
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert got == sorted(brute(rows))
    assert sum(x[2] for x in got) > 0
