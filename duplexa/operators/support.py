"""Degrees, frequent items, statistics and mega-hub filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hub_threshold


def support_rows(edges: DataFrame, side: str = "item") -> DataFrame:
    """Edges of each node, repeats counted."""
    return edges.groupBy(side).agg(F.count("*").alias("support"))


def support_distinct(edges: DataFrame, side: str = "item", other: str = "user") -> DataFrame:
    """Distinct neighbours of each node."""
    return edges.select(side, other).distinct().groupBy(side).agg(F.count("*").alias("support"))


def f_list(edges: DataFrame, min_support: int) -> DataFrame:
    """Frequent items, most frequent first, then by descending id. The order is the result; ranks need one."""
    return support_distinct(edges).where(F.col("support") >= min_support).orderBy(F.desc("support"), F.desc("item"))


def frequent(edges: DataFrame, min_support: int, by_rows: bool = False) -> DataFrame:
    """Edges whose item is frequent. The planner broadcasts the items if they are small."""
    counts = (support_rows if by_rows else support_distinct)(edges).where(F.col("support") >= min_support)
    return edges.join(counts.select("item"), "item", "left_semi").select(*edges.columns)


def stats(degrees: DataFrame, k: float = 5.0) -> DataFrame:
    """n, mean, sample variance (0 for one node) and the hub threshold of a support column."""
    out = degrees.agg(F.count("*").alias("n"), F.avg("support").alias("mean"), F.coalesce(F.var_samp("support"), F.lit(0.0)).alias("variance"))
    return out.withColumn("threshold", hub_threshold(F.col("mean"), F.col("variance"), k))


def without_hubs(degrees: DataFrame, k: float = 5.0) -> DataFrame:
    """Nodes at or below the threshold of their own statistics, which are one row."""
    return degrees.crossJoin(F.broadcast(stats(degrees, k).select("threshold"))).where("support <= threshold").drop("threshold")


def hub_filtered_edges(edges: DataFrame, min_support: int, k: float = 5.0) -> DataFrame:
    """Edges between items that are frequent and no hub, and users that are no hub; both by rows of the raw edges."""
    items = without_hubs(support_rows(edges, "item").where(F.col("support") >= min_support), k)
    users = without_hubs(support_rows(edges, "user"), k)
    return edges.join(items, "item", "left_semi").join(users, "user", "left_semi").select("user", "item")


def node_report(edges: DataFrame, min_support: int, k: float = 5.0) -> DataFrame:
    """Nodes of each side kept and dropped by the hub filter."""
    parts = []
    for side, least in (("item", min_support), ("user", 0)):
        degrees = support_rows(edges, side).where(F.col("support") >= least)
        flagged = degrees.crossJoin(F.broadcast(stats(degrees, k).select("threshold")))
        parts.append(flagged.agg(F.count_if(F.col("support") <= F.col("threshold")).alias("kept"), F.count_if(F.col("support") > F.col("threshold")).alias("dropped")).select(F.lit(side).alias("side"), "kept", "dropped"))
    return parts[0].unionByName(parts[1])


def wedges(edges: DataFrame, pivot: str = "user", proj: str = "item", rounds: int = 1) -> DataFrame:
    """Pairs each round would form, by the smaller id: look here before projecting."""
    degrees = edges.select(pivot, proj).distinct()
    items = degrees.groupBy(pivot).agg(F.array_sort(F.collect_list(proj)).alias("items"))
    at = items.select(F.posexplode("items").alias("pos", "item"), F.size("items").alias("n"))
    return at.groupBy(F.pmod("item", F.lit(rounds)).alias("round")).agg(F.sum(F.col("n") - F.col("pos") - 1).cast("bigint").alias("wedges"))


def max_per_group(edges: DataFrame, min_support: int, groups: int) -> DataFrame:
    return support_distinct(edges).where(F.col("support") >= min_support).agg(F.ceil(F.count("*") / groups).cast("bigint").alias("max_per_group"))
