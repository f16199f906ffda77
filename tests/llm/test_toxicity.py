"""op5: folding and matching by hand, held-out accuracy, edges."""

import numpy as np
from pyspark.sql import types as T

from duplexa.llm import toxicity as X

LEXICON = X.Lexicon({" idiot ": 3.0, " mor": 1.0, " moron ": 2.5}, [" viiiage idiot "], (4.0, 0.0, -4.0))


def test_fold():
    assert X.fold("Idiot, 1D10T!") == " idiot idiot "
    assert X.fold("іdіоt ｉｄｉｏｔ id​iot clown c1own") == " idiot idiot idiot ciown ciown "
    assert X.fold("b@d @ x$y $$$") == " bad xsy "
    assert X.fold("") == "  " and X.fold(" \n.") == "  "


def test_matches_by_hand():
    m = LEXICON.matcher()
    assert m.features("idiot") == (3.0, 1, 1)
    assert m.features("The moron, the M0R0N; more; idiots") == (6.0, 3, 6)  # the heaviest term of a word
    assert m.features("village idiot idiot") == (3.0, 1, 3)
    assert m.features("") == (0.0, 0, 0) == X.Lexicon().matcher().features(".")
    assert X.Lexicon().score(np.zeros((2, 3))).tolist() == [0, 0]


def test_learns_terms_exceptions_and_scores(spark):
    r = np.random.default_rng(2)
    word = lambda: "".join(r.choice(list("abcdefgh"), 4))
    docs, labels = [], []
    for i in range(400):
        w = [word() for _ in range(r.integers(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            w.insert(r.integers(len(w)), r.choice(["jerk", "JERK!", "j3rk", "јerk"]))
        elif i % 4 == 1:
            w[2:2] = ["soda", "jerk"]
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(toxic)))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType())])
    df, lab = spark.createDataFrame(docs, schema), spark.createDataFrame(labels + [(None, 1), (3, None), (5, 7)], "doc_id long, toxic int")
    lexicon = X.learn(df, lab)
    assert " jerk " in lexicon.terms and " soda jerk " in lexicon.exceptions
    got = {r["doc_id"]: r["predicted"] for r in X.score(df, lexicon).collect()}
    assert np.mean([got[i] == y for i, y in labels]) > 0.99
    odd = spark.createDataFrame([(None, None, None), (1, "", None), (1, "", None), (2, "jerk " * 20000, None)], schema)
    assert sorted((r["doc_id"] or 0, r["predicted"]) for r in X.score(odd, lexicon).collect()) == [(0, 0), (1, 0), (1, 0), (2, 1)]
    assert X.score(odd.limit(0), lexicon).count() == 0
    assert X.learn(df, lab.where("toxic = 1")).terms == {} and X.learn(df.limit(0), lab).coefficients is None


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = X.op5_toxicity(spark, d).toPandas().merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    positive = held[held.toxic == 1]
    assert (positive.predicted == 1).mean() > 0.9 and (held[held.toxic == 0].predicted == 0).mean() > 0.99
    order = held.score.rank()
    n, m = len(positive), len(held) - len(positive)
    assert (order[held.toxic == 1].sum() - n * (n + 1) / 2) / (n * m) > 0.95  # area under the curve


def plain_features(lexicon, text):
    """Sum of weights, counted words and words by looking for every term at every place."""
    folded = X.fold(text)
    words = folded.split()
    best = {}
    for term, weight in lexicon.terms.items():
        for at in range(len(folded)):
            if folded.startswith(term, at) and weight > best.get(at, 0.0):
                best[at] = weight
    for phrase in lexicon.exceptions:
        for at in range(len(folded)):
            if folded.startswith(phrase, at):
                best = {s: w for s, w in best.items() if not at <= s < at + len(phrase) - 1}
    return sum(best.values()), len(best), len(words)


def test_scores_against_a_plain_scan(spark):
    """The query's rows against looking for every learned term at every place, by plain Python."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    lexicon = X.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    assert lexicon.terms
    for r in X.score(docs, lexicon).collect():
        weight, hits, words = plain_features(lexicon, r["text"] or "")
        a, b, c = lexicon.coefficients
        logit = a * np.log1p(weight) + b * np.sqrt(weight * 100 / (words + 20)) + c
        assert (r["n_terms"], r["n_words"]) == (hits, words) and abs(r["weight"] - weight) < 1e-9
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(logit, -30, 30)))) < 1e-9 and r["predicted"] == int(r["score"] >= 0.5)
