"""op4 against counting every 400-byte string; the transform against counting rotations."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from duplexa.llm import suffix_dedup as S

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_bytes", T.StringType())])


def brute(rows):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(hash(b[s : s + 400]) for _, b in raw for s in range(len(b) - 399))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 399):
            if seen[hash(b[s : s + 400])] > 1:
                gone[s : s + 400] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in S.remove_repeats(df, **kw).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("n,length,letters", [(2, 1, 1), (50, 3, 2), (300, 9, 2), (1000, 12, 3), (2000, 30, 4), (2000, 5, 3), (400, 400, 1)])
def test_transform(n, length, letters):
    r = np.random.default_rng(n)
    x = r.integers(97, 97 + letters, n).astype(np.uint8)
    x[n // 2 : n // 2 + 200] = x[: len(x[n // 2 : n // 2 + 200])]
    b = bytes(x) * (length // n + 2)
    subs = [b[i : i + length] for i in range(n)]
    times = Counter(subs)
    assert S.repeated_starts(x, length).tolist() == [times[s] > 1 for s in subs]


def planted():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh é") for _ in range(r.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (60, 95, 100, 150, 400)] + ["z" * 399, "y" * 400, "xw" * 230]
    rows = []
    for i in range(70):
        t = text(r.randrange(150))
        for _ in range(r.randrange(3)):
            at = r.randrange(len(t) + 1)
            t = t[:at] + r.choice(shared) + t[at:]
        rows.append((i, t))
    return rows + [(80, None), (81, ""), (None, rows[3][1]), (3, rows[3][1]), (3, rows[3][1]), (82, "q" * 1000), (83, "\0" * 450), (None, None)]


@pytest.mark.parametrize("groups", [1, 6])
def test_matches_brute_force(spark, groups):
    rows = planted()
    assert run(spark, rows, groups=groups) == brute(rows)


@pytest.mark.parametrize("groups,hot", [(1, 4096), (5, 4096), (3, 1), (4, 3)])
def test_first_copy_stays(spark, tmp_path, monkeypatch, groups, hot):
    """With keep_first a byte goes only if a 400-byte string over it starts earlier in the table as well."""
    monkeypatch.setattr(S, "HOT", hot)
    rows = [(k, t) for k, (_, t) in enumerate(planted())]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    seen, want = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 399):
            if b[s : s + 400] in seen:
                gone[s : s + 400] = True
            seen.add(b[s : s + 400])
        want[i] = (len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    got = S.remove_repeats(spark.read.parquet(str(tmp_path / "t")), groups=groups, keep_first=True).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got} == want


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_grams(spark, monkeypatch, hot):
    """Grams of several kinds of segments, split to windows."""
    monkeypatch.setattr(S, "HOT", hot)
    rows = planted()
    assert run(spark, rows, groups=4) == brute(rows)


def test_long_texts(spark):
    """Texts of more than a piece, with repeats within and across the pieces' edges."""
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    once, shared = text(3 * S.PIECE // 2), text(700)
    at = S.PIECE - 350
    rows = [(1, once[:at] + shared + once[at:]), (2, "x" + shared), (3, text(500) + once[S.PIECE - 2000 : S.PIECE - 1000])]
    got = {x[0]: x[1:4] for x in run(spark, rows, groups=2)}
    assert got == {1: (len(once) + 700, 1700, 2), 2: (701, 700, 1), 3: (1500, 1000, 1)}


def test_pieces_and_units(monkeypatch):
    """Small limits: texts in pieces, several transforms a bucket (in this process)."""
    import pyarrow as pa

    rows = planted()
    want = {(x[1], x[2]) for x in brute(rows)}
    for unit, piece in ((1 << 20, 2 << 20), (900, 1000), (900, 700)):
        monkeypatch.setattr(S, "UNIT", unit)
        monkeypatch.setattr(S, "PIECE", piece)
        g = S._Group(pa.table({"text": pa.array([t for _, t in rows], pa.string()), S.ROW: pa.array(range(len(rows)), pa.int64())}), "text")
        raw = [g.buf[x:y] for x, y in zip(g.kind_start.tolist(), g.kind_stop.tolist(), strict=True)]
        bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(x) - 399).astype(bool) | m for b, x, m in zip(S._transform(g.kind_gram, raw, None), raw, g.many, strict=True)]
        gone = np.zeros(len(g.buf), bool)
        for s, k in enumerate(g.kind):
            for at in np.flatnonzero(bits[k]) + g.start[s]:
                gone[at : at + 400] = True
        assert {(int(y - x), int(gone[x:y].sum())) for x, y in zip(g.offsets[:-1], g.offsets[1:])} == want


def test_empty_and_query(spark):
    assert run(spark, []) == []
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in S.op4_suffix_dedup(spark, d).collect()), key=str)
    assert got == brute(rows) and sum(x[2] for x in got) > 0


@pytest.mark.parametrize("keep_first", [False, True])
def test_segments_are_cut_once(spark, tmp_path, keep_first):
    """All that is asked reads one exchange: asking a second time needs the time and memory of its Python workers again."""
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, f"{i} " * 300, None) for i in range(20)], SCHEMA).write.parquet(path)
    out = S.remove_repeats(spark.read.parquet(path), groups=3, give=(), keep_first=keep_first)
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FlatMapGroupsInArrow") == 2  # to ask, and to judge
