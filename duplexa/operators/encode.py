"""Dictionary encoding of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def ranked(rows: DataFrame, key: list[str], name: str = "rank") -> DataFrame:
    """``rows`` numbered 1..n in the ascending order of key columns (unique together), without one task for all.

    Rows are sorted by ranges, as many as there are shuffle partitions, and written once with the number of their range
    and place; each place is shifted by the sizes of the ranges before, one row a range.
    """
    sorted_ = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    parts = staged(sorted_.withColumn("__part", F.spark_partition_id()).withColumn("__place", place), "ranked")
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return parts.join(F.broadcast(before), "__part").select(*rows.columns, (F.col("__place") + F.col("__before")).cast("bigint").alias(name))


def numbered(values: DataFrame, column: str) -> DataFrame:
    """(index, id): the distinct values numbered 1..n in their order."""
    distinct = values.select(F.col(column).alias("id")).na.drop().distinct()
    return ranked(distinct, ["id"], "index").select("index", "id")


def encode_edges(edges: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Edges with ids replaced by the numbers of both dictionaries; edges not in both go, other columns stay."""
    u = users.select(F.col("index").alias("__u"), F.col("id").alias("user"))
    i = items.select(F.col("index").alias("__i"), F.col("id").alias("item"))
    rest = [c for c in edges.columns if c not in ("user", "item")]
    return edges.join(u, "user").join(i, "item").select(F.col("__u").alias("user"), F.col("__i").alias("item"), *rest)
