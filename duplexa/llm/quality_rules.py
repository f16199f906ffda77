"""Quality rules: decision lists learned by sequential covering.

Each text gets exact counts (``STATS``). On labelled documents a rule is grown
as a conjunction of thresholds on ratios of these counts by information gain,
pruned on held-back rows, and kept if it is precise enough there; the rows it
covers are taken out and the next rule is grown. The list becomes one Spark
conditional expression, so applying it is a projection that anyone can read.

* Null text counts as empty; a text without words has zero counts and fails
  the base (fewer than 10 words). Null ids are ordinary rows.
* Labels that are null, or neither 0 nor 1, and labels of unknown documents
  are ignored; if the labels hold only one class, the list is empty and only the
  base rejects. Repeated label rows count each.
* The fit uses at most ``MOST_LABELLED`` labelled documents, those with the
  smallest hash of their id; the rules apply to every row. A list that people are to read has
  at most ``most_rules`` rules of ``most_tests`` tests (24 and 3, parameters of the fit); covering usually ends before.
* Input columns are kept unless a result column has their name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _exchange as X
from . import _text

#: Documented bound of the labelled sample the driver holds: numbers only, no texts.
MOST_LABELLED = 20_000
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bytes", "n_upper", "n_letters", "n_digits", "n_exclaim", "n_pipes", "n_distinct", "n_doubled"]


def _flags(of: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(of)] = True
    return out


_IS = {
    "n_symbols": _flags(SYMBOLS),
    "n_upper": _flags(bytes(range(65, 91))),
    "n_letters": _flags(bytes([*range(65, 91), *range(97, 123)])),
    "n_digits": _flags(b"0123456789"),
    "n_exclaim": _flags(b"!"),
    "n_pipes": _flags(b"|"),
}
_CONTINUES = _flags(bytes(range(0x80, 0xC0)))


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def _per_doc(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n).astype(np.int64)


def _again(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows (doc, key): whether an equal row stands before in the sort, and the number of equal rows."""
    order = np.lexsort((key, doc))
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (key[order][1:] != key[order][:-1])
    run = np.cumsum(new) - 1
    later, size = np.empty(len(order), bool), np.empty(len(order), np.int64)
    later[order], size[order] = ~new, np.bincount(run)[run] if len(run) else run
    return later, size


def count(column: pa.Array) -> dict[str, np.ndarray]:
    """``STATS`` of each text of a column."""
    buf, offsets = _text.text_buffer(column)
    n = len(offsets) - 1
    w = _text.words(buf, offsets)
    out = {"n_words": np.diff(w.first).astype(np.int64), "n_bytes": np.diff(offsets)}
    inside = ~_text._SPACE[buf]
    out["word_chars"] = _sums(inside & ~_CONTINUES[buf], offsets)
    out |= {k: _sums(flags[buf], offsets) for k, flags in _IS.items()}
    # lines: a document's pieces between newlines
    cuts = np.flatnonzero(buf == 10)
    start = np.sort(np.concatenate([offsets[:-1], cuts + 1]), kind="stable")
    doc = np.concatenate([np.arange(n), np.searchsorted(offsets, cuts, "right") - 1])
    doc = np.sort(doc, kind="stable")
    stop = np.concatenate([start[1:] - 1, [len(buf)]]) if n else start
    last = np.concatenate([doc[1:] != doc[:-1], [True]]) if n else np.empty(0, bool)
    stop[last] = offsets[1:]
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(inside, out=total[1:])
    has = total[stop] > total[start]
    start, stop, doc = start[has], stop[has], doc[has]
    up, down = _text._BYTE_POWERS.get(len(buf) + 1)
    poly = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_text._BYTE_VALUE[buf] * up[:-1], out=poly[1:])
    later, _ = _again(doc, _text.mix((poly[stop] - poly[start]) * down[start]))
    out["n_lines"], out["n_dup_lines"] = _per_doc(doc, n), _per_doc(doc[later], n)
    # words and windows of five
    h, doc = w.hashes(), w.doc_of()
    later, _ = _again(doc, h)
    out["n_distinct"] = out["n_words"] - _per_doc(doc[later], n)
    same = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) if len(h) else h.astype(np.int64)
    out["n_doubled"] = _per_doc(doc[same], n)
    at = w.inside(WINDOW)
    key = _text.window_hashes(h, WINDOW)[at] if len(at) else h[:0]
    _, size = _again(doc[at], key)
    at = at[size > 1]
    edge = np.zeros(len(h) + 1, np.int64)
    edge[at] += 1
    np.add.at(edge, at + WINDOW, -1)
    out["n_repeat_words"] = _per_doc(doc[np.cumsum(edge[:-1]) > 0], n)
    return out


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` and the counts of its texts; one pass, no shuffle."""
    kinds = T.StructType([T.StructField(c, T.LongType()) for c in STATS])

    def counts(column: pa.Array) -> list[np.ndarray]:
        got = count(column)
        return [got[c].astype(np.int64) for c in STATS]

    return X.by_text(docs, text_col, kinds, lambda: counts)


#: Ratios a rule may test: name, numerator, denominator. All are 0 where the denominator is 0.
RATIOS = [
    ("symbols_per_word", "n_symbols", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("repeat_share", "n_repeat_words", "n_words"),
    ("chars_per_word", "word_chars", "n_words"),
    ("upper_share", "n_upper", "n_letters"),
    ("digit_share", "n_digits", "n_bytes"),
    ("exclaim_per_word", "n_exclaim", "n_words"),
    ("pipes_per_word", "n_pipes", "n_words"),
    ("distinct_share", "n_distinct", "n_words"),
    ("doubled_share", "n_doubled", "n_words"),
    ("words", "n_words", None),
    ("words_per_line", "n_words", "n_lines"),
]


def ratio(name: str, top: str, under: str | None) -> Column:
    return F.col(top).cast("double") if under is None else F.when(F.col(under) > 0, F.col(top) / F.col(under)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Rule:
    """All tests (ratio index, "<=" or ">", threshold) hold."""

    tests: tuple[tuple[int, str, float], ...]

    def covers(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for i, sign, at in self.tests:
            out &= (x[:, i] <= at) if sign == "<=" else (x[:, i] > at)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for i, sign, at in self.tests:
            value = ratio(*RATIOS[i])
            out = out & ((value <= F.lit(at)) if sign == "<=" else (value > F.lit(at)))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{RATIOS[i][0]} {sign} {at:.6g}" for i, sign, at in self.tests)


@dataclass
class RuleList:
    """Ordered rules that reject; what none covers is kept."""

    rules: list[Rule] = field(default_factory=list)

    def rejects(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        for r in self.rules:
            out |= r.covers(x)
        return out

    def column(self) -> Column:
        """Number of the first rule that rejects, from 1; 0 if none does."""
        out = None
        for k, r in enumerate(self.rules, 1):
            out = (F.when if out is None else out.when)(r.column(), F.lit(k))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))


def _best_test(x: np.ndarray, y: np.ndarray) -> tuple[float, tuple[int, str, float]] | None:
    """The threshold with the highest information gain for class 1, over all columns."""
    pos, neg = y.sum(), (~y).sum()
    base = np.log2(pos / (pos + neg))
    best = None
    for i in range(x.shape[1]):
        order = np.argsort(x[:, i], kind="stable")
        v, t = x[order, i], y[order]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        p, n = np.cumsum(t)[cut], np.cumsum(~t)[cut]
        middle = (v[cut] + v[cut + 1]) / 2
        for sign, a, b in (("<=", p, n), (">", pos - p, neg - n)):
            gain = a * (np.log2(np.maximum(a, 1e-9) / (a + b)) - base)
            k = int(np.argmax(gain))
            if best is None or gain[k] > best[0]:
                best = (float(gain[k]), (i, sign, float(middle[k])))
    return best if best and best[0] > 1e-9 else None


def fit(x: np.ndarray, y: np.ndarray, precision: float = 0.8, least: int = 4, most_tests: int = 3, most_rules: int = 24, seed: int = 17) -> RuleList:
    """Sequential covering. ``y`` is True where the label rejects.

    A rule stays if on the held-back third it covers ``least / 2`` rows or more and, over all rows, its
    precision less one standard error reaches ``precision``.
    """
    y = y.astype(bool)
    left, found = np.ones(len(y), bool), []
    third = np.random.default_rng(seed).random(len(y)) < 1 / 3
    while len(found) < most_rules and y[left].sum() >= least and (~y[left]).any():
        grow, hold = left & ~third, left & third
        tests: list[tuple[int, str, float]] = []
        while len(tests) < most_tests:
            inside = grow & Rule(tuple(tests)).covers(x)
            if not (~y[inside]).any() or y[inside].sum() < 2 or (test := _best_test(x[inside], y[inside])) is None:
                break
            tests.append(test[1])

        def worth(t) -> float:  # of a pruned rule on the rows held back
            c = y[hold & Rule(tuple(t)).covers(x)]
            return (2 * c.sum() - len(c)) / len(c) if len(c) else -1.0

        tests = max((tests[:k] for k in range(1, len(tests) + 1)), key=lambda t: (worth(t), -len(t)), default=[])
        rule = Rule(tuple(tests))
        c = y[left & rule.covers(x)]
        share = c.mean() if len(c) else 0.0
        if not tests or len(c) < least or (hold & rule.covers(x)).sum() < least / 2 or share - np.sqrt(share * (1 - share) / len(c)) < precision:
            break
        found.append(rule)
        left &= ~rule.covers(x)
    return RuleList(found)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED, **options) -> RuleList:
    """The rule list for labelled documents that pass the base (label 0 rejects)."""
    some = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label"))
    some = some.orderBy(F.xxhash64("__id"), "__id", "__label").limit(most)
    mine = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(some), "__id")  # at most `most` small rows
    stats = with_stats(mine, "__text").where(~base_failed())
    rows = stats.select(F.col("__label").cast("int").alias("y"), *[ratio(*r).alias(f"x{i}") for i, r in enumerate(RATIOS)]).toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")
    x, y = rows.drop(columns="y").to_numpy(float), rows["y"].to_numpy() == 0
    return fit(x, y, **options) if len(y) else RuleList()


def judge(docs: DataFrame, rules: RuleList, text_col: str = "text") -> DataFrame:
    """``docs`` with its counts, base_failed, rule (the one that rejects, or 0) and kept."""
    out = with_stats(docs.drop("base_failed", "rule", "kept"), text_col).withColumn("base_failed", base_failed()).withColumn("rule", rules.column())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
