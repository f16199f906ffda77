"""Evaluation of recommendations and of projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import average_precision


def map_at_k(actual: DataFrame, predicted: DataFrame, k: int) -> DataFrame:
    """(user, ap) of every user with a truth (user, items); a user without predictions scores as an empty list."""
    rows = actual.withColumnRenamed("items", "actual").join(predicted.withColumnRenamed("items", "predicted"), "user", "left")
    return rows.select("user", average_precision(F.col("predicted"), F.col("actual"), k).alias("ap"))


def mean_ap(actual: DataFrame, predicted: DataFrame, k: int) -> DataFrame:
    return map_at_k(actual, predicted, k).agg(F.avg("ap").alias("map"))


def verify(recs: DataFrame, expected: int = 500) -> DataFrame:
    """Rows of (user, items) that are empty, and those of another length than expected."""
    size = F.coalesce(F.size("items"), F.lit(0))
    return recs.agg(F.count("*").alias("n"), F.count_if(size == 0).alias("empty"), F.count_if(size != expected).alias("wrong_length"))


def share(*keys: str, salt: int = 0) -> Column:
    """A fixed number in [0, 1000) for each key: the same split on every engine with crc32."""
    return F.crc32(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(salt)))) % 1000


def hold_out(ratings: DataFrame, train: float = 0.7, users: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(train, test): a fixed part of the users, and of each one's ratings a fixed part for training."""
    some = ratings.where(share("user", salt=1) < int(users * 1000))
    return some.where(share("user", "item") < int(train * 1000)), some.where(share("user", "item") >= int(train * 1000))


def errors(predictions: DataFrame) -> DataFrame:
    """Root mean square and mean absolute error of (rating, prediction)."""
    d = F.col("prediction") - F.col("rating")
    return predictions.agg(F.count("*").alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"))


def precision_recall(recs: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Means over users with relevant items: precision (hits of those recommended), recall and F1 at k."""
    top = recs.where(F.col("rank") <= k).select("user", "item")
    hits = top.join(relevant, ["user", "item"], "left_semi").groupBy("user").agg(F.count("*").alias("hits"))
    given = top.groupBy("user").agg(F.count("*").alias("given"))
    wanted = relevant.groupBy("user").agg(F.count("*").alias("wanted"))
    rows = wanted.join(given, "user", "left").join(hits, "user", "left").na.fill(0, ["given", "hits"])
    means = rows.agg(F.count("*").alias("users"), F.avg(F.when(F.col("given") > 0, F.col("hits") / F.col("given"))).alias("precision"), F.avg(F.col("hits") / F.col("wanted")).alias("recall"))
    return means.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
