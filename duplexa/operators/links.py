"""Projected links: adjacency form, canonical order, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canonical


def adjacency(links: DataFrame) -> DataFrame:
    """(item, adj): the neighbours of each item with their support, by id; items without any have no row."""
    both = links.select(F.col("p1").alias("item"), F.col("p2").alias("other"), "support").unionByName(links.select(F.col("p2").alias("item"), F.col("p1").alias("other"), "support"))
    return both.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("other", "support"))).alias("adj")).where(F.size("adj") > 0)


def flattened(adjacency_: DataFrame) -> DataFrame:
    return adjacency_.select("item", F.inline("adj"))


def canonicalise(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    low, high = canonical(a, b)
    return links.select(low.alias("p1"), high.alias("p2"), *[c for c in links.columns if c not in (a, b)])


def best_links(links: DataFrame) -> DataFrame:
    """The highest support of partial links to a pair."""
    return links.groupBy("p1", "p2").agg(F.max("support").alias("support"))


def diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Pairs that are missing, wrong (other support) or extra in ``actual``."""
    both = expected.withColumnRenamed("support", "expected").join(actual.withColumnRenamed("support", "actual"), ["p1", "p2"], "full_outer")
    kind = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(F.col("expected") != F.col("actual"), "wrong")
    return both.withColumn("kind", kind).where("kind is not null")
