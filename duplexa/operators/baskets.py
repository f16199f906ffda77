"""Baskets: the items of each user as arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import frequent, support_distinct


def baskets(edges: DataFrame) -> DataFrame:
    """Sorted distinct items of each user."""
    return edges.na.drop().groupBy("user").agg(F.array_sort(F.collect_set("item")).alias("items"))


def weighted_baskets(baskets_: DataFrame) -> DataFrame:
    """Equal baskets once, with how often they occur."""
    return baskets_.groupBy("items").agg(F.count("*").alias("weight"))


def exploded_counts(baskets_: DataFrame) -> DataFrame:
    return baskets_.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("support"))


def basket_pairs(baskets_: DataFrame, weight: str | None = None) -> DataFrame:
    """Every pair of a sorted basket, the smaller id first. Pairs stream from two generators: no row holds more than a basket."""
    extra = [] if weight is None else [weight]
    at = baskets_.where(F.size("items") > 1).select(*extra, "items", F.posexplode("items").alias("pos", "p1"))
    return at.select(*extra, "p1", F.explode(F.slice("items", F.col("pos") + 2, F.size("items"))).alias("p2"))


def listed(rows: DataFrame, order: str) -> DataFrame:
    """(user, items): all items of each user in the order of a column, repeats kept; ties by ascending item."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("item").alias("item"))))
    return rows.na.drop(subset=["user", "item"]).groupBy("user").agg(F.transform(pairs, lambda x: x["item"]).alias("items"))


def ranked_baskets(edges: DataFrame, min_support: int) -> DataFrame:
    """Frequent items of each user, most frequent first, then by descending id."""
    counts = support_distinct(edges).where(F.col("support") >= min_support)
    rows = edges.select("user", "item").distinct().join(counts, "item")
    keyed = F.array_sort(F.collect_list(F.struct((-F.col("support")).alias("s"), (-F.col("item")).alias("i"), "item")))
    return rows.groupBy("user").agg(F.transform(keyed, lambda x: x["item"]).alias("items"))


def group_dependent(edges: DataFrame, min_support: int, groups: int) -> DataFrame:
    """For each user and group of items (id modulo groups), the basket's prefix up to the group's last item."""
    last = lambda g: F.array_max(F.transform("items", lambda x, k: F.when(F.pmod(x, F.lit(groups)) == g, k + 1).otherwise(0)))
    ends = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint")), lambda g: F.struct(g.alias("grp"), last(g).alias("size")))
    at = ranked_baskets(edges, min_support).select("user", "items", F.explode(F.filter(ends, lambda e: e["size"] > 0)).alias("e"))
    return at.select("user", "e.grp", F.slice("items", F.lit(1), F.col("e.size")).alias("prefix"))


def frequent_baskets(edges: DataFrame, min_support: int) -> DataFrame:
    return baskets(frequent(edges.select("user", "item").distinct(), min_support))


def transaction_averages(edges: DataFrame, min_support: int, groups: int) -> DataFrame:
    """Number and mean length of the group-dependent prefixes."""
    return group_dependent(edges, min_support, groups).agg(F.count("*").alias("n"), F.avg(F.size("prefix")).alias("mean_length"))
