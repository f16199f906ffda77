"""Toxicity by a weighted lexicon and Aho-Corasick.

Texts are folded: lower case, compatibility forms, look-alike letters of other
scripts, digits and signs that stand for letters. The lexicon is learned from labelled
documents: whole words and word beginnings that toxic ones hold more often than
chance allows over all terms tried, weighted by log odds. Phrases of two words
around a term that only harmless documents use, and often, become exceptions. One
automaton finds both; a word counts once, by its heaviest term, unless an
exception covers it. The score is logistic in the sum of weights and in that sum
normalised by length.

* Null texts count as empty; texts without a term get the score of a weight of
  zero. Ids, labels, language and source are no inputs of a score; rows with
  null, equal or repeated ids are scored alike.
* Labels other than 0 and 1, null ids, and held-out documents (crc32 of the id as
  text divisible by 5) teach nothing; repeated label rows count each. Without
  both classes the lexicon is empty and every score 0.
* The fit uses at most ``MOST_LABELLED`` labelled documents, those with the smallest hash of
  their id, which bounds the lexicon too: every term and phrase that passes the tests is in it.
  Scores cover every row and whole texts.
* Input columns are kept unless a result column has their name.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _exchange as X
from . import _text

#: Documented bound of the labelled sample.
MOST_LABELLED = 20_000
PREFIXES = (3, 4, 5, 6)
SLICE = 1 << 20

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ᴏ": "o",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
HIDDEN = ["­", "​", "‌", "‍", "⁠", "﻿"]

_FOLD = {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()}
_FOLD |= {ord(c): None for c in HIDDEN}
_FOLD |= {c: " " for c in range(128) if not chr(c).isalnum()}
_FOLD |= {ord(c): " " for c in "¡¿«»“”„‘’…–—·、。！？\xa0\x85"}
_FOLD[ord("l")] = "i"  # 1 stands for both
_SIGNS = re.compile(r"(?<=[^\W\d_])[@$](?=[^\W\d_])")


def fold(text: str) -> str:
    """Words of letters in the folded alphabet, with one space around each."""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if "@" in text or "$" in text:
        text = _SIGNS.sub(lambda m: "a" if m[0] == "@" else "s", text)
    return " " + " ".join(text.translate(_FOLD).split()) + " "


@dataclass
class Lexicon:
    """Terms " word " and " begin" with weights, exception phrases, and the logistic's coefficients."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    coefficients: tuple[float, float, float] | None = None

    def matcher(self) -> Matcher:
        return Matcher(self)

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.coefficients is None:
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(_inputs(features) @ np.array(self.coefficients), -30, 30)))


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.automaton = ahocorasick.Automaton() if lexicon.terms else None
        if self.automaton is not None:
            for t, w in lexicon.terms.items():
                self.automaton.add_word(t, (len(t), w))
            for p in lexicon.exceptions:
                self.automaton.add_word(p, (len(p), None))
            self.automaton.make_automaton()

    def features(self, text: str) -> tuple[float, int, int]:
        """Sum of weights, number of words that counted, number of words."""
        folded = fold(text)
        words = folded.count(" ") - 1 if len(folded) > 2 else 0
        if self.automaton is None:
            return 0.0, 0, words
        best, spans = {}, []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                spans.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        for a, b in spans:  # an exception's words begin at spaces from its first to before its last
            for s in [s for s in best if a <= s < b]:
                del best[s]
        return sum(best.values()), len(best), words


def _inputs(features: np.ndarray) -> np.ndarray:
    """Log of the weight, weight by length, and 1."""
    weight, words = features[:, 0], features[:, 2]
    return np.stack([np.log1p(weight), np.sqrt(weight * 100 / (words + 20)), np.ones(len(features))], 1)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _terms(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        if len(w) >= 3:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in PREFIXES if len(w) >= k)
    return out


def _phrases(folded: str, terms: set[str]) -> set[str]:
    """Two-word phrases around words that begin with or equal a term."""
    words = folded.split()
    hit = [i for i, w in enumerate(words) if f" {w} " in terms or any(f" {w[:k]}" in terms for k in PREFIXES)]
    return {f" {words[i]} {words[i + 1]} " for at in hit for i in (at - 1, at) if 0 <= i < len(words) - 1}


def _counted(rows: DataFrame, of) -> DataFrame:
    """(term, toxic, clean): labelled documents that hold each term; counted by slice before the shuffle."""

    def run(batches):
        for batch in _text.slices(batches, "__text", SLICE):
            toxic, clean = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if label else clean).update(of(fold(text or "")))
            terms = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())], names=["term", "toxic", "clean"])

    return rows.mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with a small ridge; classes count as they are."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_labelled: int = MOST_LABELLED) -> Lexicon:
    """The lexicon of the labelled documents that are not held out."""
    spark = docs.sparkSession
    X.ship(spark)
    some = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
    some = some.orderBy(F.xxhash64("__id"), "__id", "__label").limit(most_labelled)
    mine = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(some), "__id").select("__text", "__label")  # at most most_labelled ids
    mine = X.written(mine, "labelled")
    n = {r["__label"]: r["count"] for r in mine.groupBy("__label").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Lexicon()
    counted = X.written(_counted(mine, _terms), "terms")
    tried = max(2, counted.count())
    c = F.col
    a, b, total = c("toxic").cast("double"), c("clean").cast("double"), float(toxic + clean)
    # G squared of the two-by-two table of term and label
    g = 2 * (
        _xlogx(a) + _xlogx(b) + _xlogx(F.lit(float(toxic)) - a) + _xlogx(F.lit(float(clean)) - b) + F.lit(total * math.log(total))
        - _xlogx(a + b) - _xlogx(F.lit(total) - a - b) - F.lit(toxic * math.log(toxic)) - F.lit(clean * math.log(clean))
    )
    weight = F.log((a + 0.5) / (toxic - a + 0.5)) - F.log((b + 0.5) / (clean - b + 0.5))
    chosen = counted.select("term", "toxic", g.alias("g"), weight.alias("weight")).where(f"toxic >= 3 and weight >= 2 and g >= {2 * math.log(tried) + 2}")
    rows = chosen.orderBy(c("g").desc(), "term").collect()
    # a beginning that is little more than one longer term says nothing about other words
    most = Counter()
    for r in rows:
        for k in range(4, len(r["term"])):
            most[r["term"][:k]] = max(most[r["term"][:k]], r["toxic"])
    out = Lexicon({r["term"]: float(r["weight"]) for r in rows if r["term"].endswith(" ") or most[r["term"]] < 0.9 * r["toxic"]})
    terms = set(out.terms)
    if terms:
        phrases = _counted(mine, lambda folded: _phrases(folded, terms)).where("toxic = 0 and clean >= 3")
        out.exceptions = sorted(r["term"] for r in phrases.collect())
    points = _featured(mine, out, "__text").select("__label", "weight", "n_terms", "n_words").toPandas()
    points = points.sort_values(list(points.columns), kind="stable").to_numpy(float)
    out.coefficients = tuple(float(v) for v in _logistic(_inputs(points[:, 1:]), points[:, 0]))
    return out


FEATURES = T.StructType([T.StructField("weight", T.DoubleType()), T.StructField("n_terms", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("score", T.DoubleType())])


def _featured(docs: DataFrame, lexicon: Lexicon, text_col: str) -> DataFrame:
    def make():
        matcher = lexicon.matcher()

        def features(column: pa.Array) -> list:
            found = np.array([matcher.features(t or "") for t in column.to_pylist()], float).reshape(-1, 3)
            return [found[:, 0], found[:, 1].astype(np.int64), found[:, 2].astype(np.int64), lexicon.score(found)]

        return features

    return X.by_text(docs, text_col, FEATURES, make)


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """``docs`` with weight, n_terms, n_words, score and predicted."""
    return _featured(docs.drop("predicted"), lexicon, text_col).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_terms")
