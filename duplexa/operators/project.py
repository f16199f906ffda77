"""Bipartite projection: pairs of items that share at least so many users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage_path, staged
from .baskets import basket_pairs, frequent_baskets, group_dependent, weighted_baskets
from .support import frequent, hub_filtered_edges

#: A user with more items is paired by blocks of this many, each pair of blocks by itself.
HEAVY = 5_000
STRATEGIES = ("join", "baskets", "weighted", "rounds", "groups")


def _cells(edges: DataFrame, heavy: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the self-join. A heavy user's items are dealt to blocks, and a row goes to the cells of its block, so that each pair meets in one cell."""
    degrees = edges.groupBy("user").agg(F.ceil(F.count("*") / heavy).cast("int").alias("blocks")).where("blocks > 1")
    if not degrees.limit(1).count():
        return edges, edges
    wide = edges.join(degrees, "user", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block, others = F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    rest = [c for c in edges.columns if c != "user"]
    side = lambda cell: wide.withColumn("cell", F.explode(F.transform(others, cell))).select(F.struct("user", "cell").alias("user"), *rest)
    return side(lambda o: block * F.col("blocks") + o), side(lambda o: o * F.col("blocks") + block)


def _joined(edges: DataFrame, extra=None, symmetric: bool = False, heavy: int = HEAVY, more: dict | None = None) -> DataFrame:
    """Self-join on the user with the pair order in the join condition; counts are combined before their shuffle.

    ``more`` names further columns of the result, computed from both rows (as a and b) of any of a pair's matches.
    """
    left, right = _cells(edges, heavy)
    a, b = left.alias("a"), right.alias("b")
    order = F.col("a.item") != F.col("b.item") if symmetric else F.col("a.item") < F.col("b.item")
    on = (F.col("a.user") == F.col("b.user")) & order
    if extra is not None:
        on = on & extra
    extras = [F.max(x).alias(name) for name, x in (more or {}).items()]
    return a.join(b, on).groupBy(F.col("a.item").alias("p1"), F.col("b.item").alias("p2")).agg(F.count("*").alias("support"), *extras)


def _rounds(edges: DataFrame, rounds: int, min_support: int, heavy: int) -> DataFrame:
    """One round after the other, each written before the next begins: the pairs of one round are all that is held at a time."""
    spark, path = edges.sparkSession, stage_path(edges.sparkSession, "rounds")
    for k in range(rounds):
        one = _joined(edges, F.pmod(F.col("a.item"), F.lit(rounds)) == k, heavy=heavy).where(F.col("support") >= min_support)
        one.write.mode("append").parquet(path)
    return spark.read.schema(one.schema).parquet(path)


def project(edges: DataFrame, min_support: int = 2, semantics: str = "set", prefilter: bool | None = None, strategy: str = "join", rounds: int = 4, user_space: bool = False, hub_k: float | None = None, symmetric: bool = False, heavy: int = HEAVY) -> DataFrame:
    """(p1, p2, support) with p1 < p2 and support >= min_support; ``symmetric`` gives both orders.

    ``semantics="set"`` counts users, "bag" multiplies repeated edges. The prefilter drops items too rare to be in any
    pair; it loses nothing under "set" (the default there) and, by rows, may under "bag" (off by default). Strategies
    differ in plan, never in result; others than "join" are for sets. "rounds" runs when it is called, a round at a time.
    """
    if strategy not in STRATEGIES or semantics not in ("set", "bag"):
        raise ValueError(f"unknown strategy or semantics: {strategy}, {semantics}")
    if strategy != "join" and (semantics == "bag" or symmetric):
        raise ValueError("bags and symmetric results are for the join strategy")
    e = edges.select(F.col("item").alias("user"), F.col("user").alias("item")) if user_space else edges.select("user", "item")
    e = e.na.drop()
    if hub_k is not None:
        e = hub_filtered_edges(e, min_support, hub_k)
    if semantics == "set":
        e = e.distinct()
    if prefilter if prefilter is not None else semantics == "set":
        e = frequent(e, min_support, by_rows=True)  # rows of distinct edges are distinct users
    if strategy in ("join", "rounds"):
        e = staged(e, "edges")  # read for the degrees and for both sides
    if strategy == "join":
        out = _joined(e, symmetric=symmetric, heavy=heavy)
    elif strategy == "baskets":
        out = basket_pairs(frequent_baskets(e, 1)).groupBy("p1", "p2").agg(F.count("*").alias("support"))
    elif strategy == "weighted":
        out = basket_pairs(weighted_baskets(frequent_baskets(e, 1)), "weight").groupBy("p1", "p2").agg(F.sum("weight").alias("support"))
    elif strategy == "rounds":
        return _rounds(e, rounds, min_support, heavy)
    else:
        out = _grouped(e, rounds)
    return out.where(F.col("support") >= min_support)


def _grouped(edges: DataFrame, groups: int) -> DataFrame:
    """Pairs of each group's own items with the items before them, over weighted prefixes; a pair is in one group only."""
    prefixes = group_dependent(edges, 1, groups).groupBy("grp", "prefix").agg(F.count("*").alias("weight"))
    own = prefixes.select("weight", "prefix", "grp", F.posexplode("prefix").alias("pos", "x")).where(F.pmod("x", F.lit(groups)) == F.col("grp"))
    pairs = own.where("pos > 0").select("weight", "x", F.explode(F.slice("prefix", F.lit(1), F.col("pos"))).alias("y"))
    return pairs.groupBy(F.least("x", "y").alias("p1"), F.greatest("x", "y").alias("p2")).agg(F.sum("weight").alias("support"))
