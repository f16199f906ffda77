"""op8: counts against plain Python, learning on planted rules, edge cases."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from duplexa.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen, again = set(), 0
    for x in lines:
        again += x in seen
        seen.add(x)
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    hit = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"), "n_dup_lines": again,
        "n_repeat_words": len(hit), "n_distinct": len(set(w)), "n_lines": len(lines), "n_doubled": sum(a == b for a, b in zip(w, w[1:])),
    }


TEXTS = ["", None, " \n\t", "a", "é ü x y", "a\na\n\na \na", "x y z v w " * 4, "a b c d e f a b c d e", "#*$%&|<> !!", "α β\nα β", "a a a b b", "\n\nline\nline\n", "tail\n"] * 2


def test_counts_match_plain_python():
    got = Q.count(pa.array(TEXTS))
    for i, t in enumerate(TEXTS):
        want = brute(t)
        assert {k: int(got[k][i]) for k in want} == want, t


def test_counts_on_documents(spark):
    rows = Q.with_stats(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    assert len(rows) == 200
    for r in rows:
        want = brute(r["text"])
        assert {k: r[k] for k in want} == want


def test_fit_finds_a_planted_conjunction():
    r = np.random.default_rng(1)
    x = r.random((4000, 4))
    y = (x[:, 1] > 0.8) & (x[:, 2] <= 0.5)
    rules = Q.fit(x, y)
    assert (rules.rejects(x) == y).mean() > 0.99
    assert not Q.fit(x, np.zeros(4000, bool)).rules
    assert not Q.fit(x, np.ones(4000, bool)).rules
    assert not Q.fit(x, r.random(4000) < 0.3).rules  # noise teaches nothing


def test_query_and_edges(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("n_words", T.StringType())])
    df = spark.createDataFrame([(1, "", "x", "y"), (None, None, "x", "y"), (1, "a b c d e " * 3, "x", "y"), (2, " ".join(map(str, range(12))), None, None)], schema)
    rows = Q.judge(df, Q.RuleList()).select("doc_id", "n_words", "base_failed", "kept").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(1, 0, True, False), (None, 0, True, False), (1, 15, True, False), (2, 12, False, True)], key=str)
    assert Q.judge(df.limit(0), Q.RuleList()).count() == 0
    labels = spark.createDataFrame([(1, None), (None, 0), (9, 0)], "doc_id long, quality int")
    assert Q.learn(df, labels).rules == []
    got = Q.op8_quality_rules(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    both = both[~both.base_failed]
    assert (both.kept == (both.quality == 1)).mean() > 0.97


def test_verdicts_against_plain_rules(spark):
    """The conditional expression's verdict on every document equals the rules applied one by one to plain counts."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rules = Q.learn(docs, spark.read.parquet(f"{d}/labels.parquet"))
    assert rules.rules
    got = {r["doc_id"]: r for r in Q.judge(docs, rules).collect()}
    for i, r in got.items():
        n = brute(r["text"]) | {k: r[k] for k in ("n_bytes", "n_upper", "n_letters", "n_digits", "n_exclaim", "n_pipes")}
        raw = (r["text"] or "").encode()
        assert (n["n_bytes"], n["n_exclaim"], n["n_pipes"], n["n_digits"]) == (len(raw), raw.count(b"!"), raw.count(b"|"), sum(48 <= x < 58 for x in raw))
        first = 0
        for k, rule in enumerate(rules.rules, 1):
            values = [(n[Q.RATIOS[at][1]] / (n[Q.RATIOS[at][2]] or np.inf) if Q.RATIOS[at][2] else float(n[Q.RATIOS[at][1]]), sign, bound) for at, sign, bound in rule.tests]
            if not first and all(v <= b if sign == "<=" else v > b for v, sign, b in values):
                first = k
        failed = n["n_words"] < 10 or 100 * n["n_repeat_words"] > 20 * n["n_words"]
        assert (r["base_failed"], r["rule"], r["kept"]) == (failed, first, not failed and first == 0), i


def test_a_filter_counts_a_text_once(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "some words of a text"), (2, None)], "doc_id long, text string").write.parquet(path)
    kept = Q.judge(spark.read.parquet(path), Q.RuleList()).where("kept").select("doc_id", "text")
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert kept.count() == 0
