"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sub_string(x: Column | str, start: int, end: int) -> Column:
    """Characters start (from 0) to end (exclusive); null past the text's end."""
    return F.nullif(F.substring(_col(x), start + 1, end - start), F.lit(""))


def to_long(x: Column | str) -> Column:
    return _col(x).try_cast("bigint")


def canonical(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    return F.least(_col(a), _col(b)), F.greatest(_col(a), _col(b))


def group_of(x: Column | str, groups: int) -> Column:
    return F.pmod(_col(x), F.lit(groups))


def range_group_of(x: Column | str, size: int) -> Column:
    """Group by consecutive ids."""
    return F.floor(_col(x) / F.lit(size)).cast("bigint")


def alphabet_position(x: Column | str, alphabet: str) -> Column:
    """Place of a letter, from 0; -1 if absent."""
    return (F.instr(F.lit(alphabet), _col(x)) - 1).cast("bigint")


def hub_threshold(mean: Column, variance: Column, k: float = 5.0) -> Column:
    return F.floor(mean + F.lit(k) * F.sqrt(variance)).cast("bigint")


def xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))


def log_likelihood(both: Column, one: Column, two: Column, total: Column) -> Column:
    """G squared of co-occurrence: pair support, the two degrees, number of pivots."""
    k11, k12, k21, k22 = (x.cast("double") for x in (both, two - both, one - both, total - one - two + both))
    rows = xlogx(k11 + k12) + xlogx(k21 + k22)
    cols = xlogx(k11 + k21) + xlogx(k12 + k22)
    cells = xlogx(k11) + xlogx(k12) + xlogx(k21) + xlogx(k22)
    return F.greatest(F.lit(0.0), 2 * (cells - rows - cols + xlogx(k11 + k12 + k21 + k22)))


def average_precision(predicted: Column, actual: Column, k: int) -> Column:
    """AP@k of two arrays: hits count once, at their first place; an empty truth gives 1."""
    top = F.slice(F.coalesce(predicted, F.array().cast("array<bigint>")), 1, k)
    hits = F.transform(top, lambda x, i: F.when(F.array_contains(actual, x) & (F.array_position(top, x) == i + 1), 1.0).otherwise(0.0))
    gained = F.aggregate(
        F.arrays_zip(hits.alias("h"), F.sequence(F.lit(1), F.greatest(F.size(hits), F.lit(1))).alias("i")),
        F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s")),
        lambda a, x: F.struct((a["n"] + F.coalesce(x["h"], F.lit(0.0))).alias("n"), (a["s"] + F.when(x["h"] > 0, (a["n"] + 1) / x["i"]).otherwise(0.0)).alias("s")),
        lambda a: a["s"],
    )
    return F.when(F.size(actual) == 0, F.lit(1.0)).otherwise(gained / F.least(F.size(actual), F.lit(k)))
