"""Popularity, neighbourhood and matrix-factorisation recommenders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import log_likelihood
from ..sources.staging import shared_folder, ship, staged, written
from . import blocks
from .encode import ranked
from .project import _joined
from .support import support_distinct, support_rows


def popularity(edges: DataFrame) -> DataFrame:
    """(item, support, rank): rows of each item, ranked by support and ascending id."""
    counts = support_rows(edges, "item").withColumn("less", -F.col("support"))
    return ranked(counts, ["less", "item"]).select("item", "support", "rank")


def top_popular(edges: DataFrame, n: int = 500) -> DataFrame:
    return support_rows(edges, "item").orderBy(F.desc("support"), "item").limit(n)


#: Places of the popular list that are broadcast (8 MB at most).
LISTED = 1_000_000


def popular_unseen(edges: DataFrame, n: int = 500, listed: int = LISTED) -> DataFrame:
    """For every user, the n most popular items outside the user's history.

    A user needs the first n + (own history) places of the popular list at most. Users for whom ``listed`` places are
    enough take them from one broadcast array; others meet the list by place.
    """
    seen = edges.select("user", "item").distinct()
    baskets = seen.groupBy("user").agg(F.collect_list("item").alias("items"))
    top = popularity(edges).select("item", F.col("rank").alias("place"))
    longest = (baskets.agg(F.max(F.size("items"))).first()[0] or 0) + n
    first = top.where(F.col("place") <= min(longest, listed))
    array = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]).alias("top"))
    few = baskets.where(F.size("items") + n <= listed).crossJoin(F.broadcast(array))
    fresh = F.slice(F.array_except(F.slice("top", F.lit(1), F.size("items") + n), "items"), 1, n)
    out = few.select("user", F.posexplode(fresh).alias("rank", "item")).select("user", "item", (F.col("rank") + 1).alias("rank"))
    if longest <= listed:
        return out
    heavy = baskets.where(F.size("items") + n > listed).select("user", F.size("items").alias("own"))
    places = heavy.select("user", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("own").cast("bigint") + n)).alias("place"))
    unseen = places.join(top, "place").join(seen, ["user", "item"], "left_anti")
    rest = unseen.withColumn("rank", F.row_number().over(Window.partitionBy("user").orderBy("place"))).where(F.col("rank") <= n)
    return out.unionByName(rest.select("user", "item", "rank"))


def with_fallback(users: DataFrame, recs: DataFrame, popular: DataFrame) -> DataFrame:
    """(user, items, fallback): the popular list where a user has no or an empty recommendation."""
    default = popular.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("support")).alias("s"), "item"))), lambda x: x["item"]).alias("popular"))
    both = users.select("user").join(recs.select("user", "items"), "user", "left").crossJoin(F.broadcast(default))
    empty = F.col("items").isNull() | (F.size("items") == 0)
    return both.select("user", F.when(empty, F.col("popular")).otherwise(F.col("items")).alias("items"), empty.alias("fallback"))


def llr_similarity(edges: DataFrame, min_support: int = 1) -> DataFrame:
    """(p1, p2, support, llr, similarity) of item pairs by log-likelihood over boolean preferences."""
    e = edges.select("user", "item").distinct()
    total = e.agg(F.count_distinct("user").alias("total"))
    e = staged(e.join(support_distinct(e), "item").where(F.col("support") >= min_support), "edges")  # degrees go with the edges through the self-join
    pairs = _joined(e, more={"d1": F.col("a.support"), "d2": F.col("b.support")}).where(F.col("support") >= min_support)
    rows = pairs.crossJoin(F.broadcast(total))
    llr = log_likelihood(F.col("support"), F.col("d1"), F.col("d2"), F.col("total"))
    return rows.withColumn("llr", llr).select("p1", "p2", "support", "llr", (1 - 1 / (1 + F.col("llr"))).alias("similarity"))


def both_ways(pairs: DataFrame, a: str, b: str, value: str | Column = "similarity") -> DataFrame:
    x = F.col(value) if isinstance(value, str) else value
    return pairs.select(F.col(a).alias("x"), F.col(b).alias("y"), x.alias("similarity")).unionByName(pairs.select(F.col(b).alias("x"), F.col(a).alias("y"), x.alias("similarity")))


def nearest(similar: DataFrame, n: int) -> DataFrame:
    """The n most similar y of each x; ties by ascending y, similarity to nine places."""
    order = Window.partitionBy("x").orderBy(F.desc(F.round("similarity", 9)), "y")
    return similar.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def _top(scored: DataFrame, seen: DataFrame, n: int) -> DataFrame:
    """The n best unseen items of each user; ties by ascending item, scores to six places."""
    fresh = scored.join(seen, ["user", "item"], "left_anti").withColumn("score", F.round("score", 6))
    order = Window.partitionBy("user").orderBy(F.desc("score"), "item")
    return fresh.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("user", "item", "score", "rank")


def item_based(edges: DataFrame, n: int = 10, min_support: int = 2) -> DataFrame:
    """Unseen items by the sum of their log-likelihood similarities to the user's; ties by ascending item, scores to six places."""
    return blocks.by_items(blocks.stored(edges, "item"), n, min_support)


def user_neighbours(edges: DataFrame, neighbours: int = 20, min_support: int = 1) -> DataFrame:
    """(x, y, similarity, place): nearest users by log-likelihood; ties by ascending y, similarity to nine places."""
    return blocks.near(blocks.stored(edges, "user"), neighbours, min_support)


def user_based(edges: DataFrame, n: int = 10, neighbours: int = 20, min_support: int = 1) -> DataFrame:
    """Unseen items by the sum of the similarities of the nearest users that have them; ties by ascending item, scores to six places."""
    seen = blocks.stored(edges, "user")
    return blocks.by_users(seen, written(blocks.near(seen, neighbours, min_support), "near"), n)


def pearson(ratings: DataFrame, min_common: int = 2) -> DataFrame:
    """(u1, u2, common, similarity): correlation of two users over the items both rated; undefined ones are left out."""
    a, b = ratings.alias("a"), ratings.alias("b")
    joined = a.join(b, (F.col("a.item") == F.col("b.item")) & (F.col("a.user") < F.col("b.user")))
    x, y = F.col("a.rating").cast("double"), F.col("b.rating").cast("double")
    sums = joined.groupBy(F.col("a.user").alias("u1"), F.col("b.user").alias("u2")).agg(F.count("*").alias("common"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    n = F.col("common")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    value = F.when((vx > 1e-9) & (vy > 1e-9), (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy))
    return sums.where(n >= min_common).select("u1", "u2", "common", value.alias("similarity")).where("similarity is not null")


def pearson_based(ratings: DataFrame, n: int = 20, neighbours: int = 100, min_common: int = 2) -> DataFrame:
    """Unseen items by the mean rating of the nearest users, weighted by similarity; only positive weights sum to a score."""
    near = nearest(both_ways(pearson(ratings, min_common), "u1", "u2"), neighbours).where("round(similarity, 9) > 0")
    rows = near.join(ratings.select(F.col("user").alias("y"), "item", "rating"), "y")
    scored = rows.groupBy(F.col("x").alias("user"), "item").agg((F.sum(F.col("similarity") * F.col("rating")) / F.sum("similarity")).alias("score"))
    return _top(scored, ratings.select("user", "item").distinct(), n)


def als(ratings: DataFrame, rank: int = 20, reg: float = 0.1, iterations: int = 10, implicit: bool = False, alpha: float = 40.0, seed: int = 7):
    """An ALS model; ids must fit 32 bits (encode them first). Factors go to the shared folder every other iteration, and the shuffle files before them go."""
    from pyspark.ml.recommendation import ALS

    shared_folder(ratings.sparkSession)
    return ALS(checkpointInterval=2, rank=rank, regParam=reg, maxIter=iterations, implicitPrefs=implicit, alpha=alpha, seed=seed, userCol="user", itemCol="item", ratingCol="rating", coldStartStrategy="drop").fit(ratings)


#: Bytes of item factors that are broadcast at a time, users and items scored at a time.
FACTOR_BYTES, USERS, TILE = 160 << 20, 64, 16_384


def _best_unseen(u: np.ndarray, seen: list[np.ndarray], ids: np.ndarray, factors: np.ndarray, norms: np.ndarray, n: int, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of u, place in ids, score): the n best of the ids that a user has not seen, by descending rounded score, then id.

    Items come by descending length of their factors: a tile whose bound is below a user's n-th best cannot change its list.
    """
    m = len(u)
    least, lengths = np.full(m, -np.inf, np.float32), np.sqrt((u.astype(float) ** 2).sum(1))
    mine = np.repeat(np.arange(m), [len(x) for x in seen])
    gone = np.concatenate([*seen, np.empty(0, np.int64)])  # places in ids; those out of it are left out before
    row, at, score, news = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32), []
    for a in range(0, len(ids), tile):
        live = np.flatnonzero(lengths * norms[a] >= least - 2e-6 - 1e-6 * np.abs(least))
        if not len(live):
            break
        some = u[live] @ factors[a : a + tile].T
        back = np.full(m, -1)
        back[live] = np.arange(len(live))
        here = (gone >= a) & (gone < a + tile) & (back[mine] >= 0)
        some[back[mine[here]], gone[here] - a] = -np.inf
        if some.shape[1] > n and np.isneginf(least[live]).any():
            floor = np.maximum(least[live], np.partition(some, -n, axis=1)[:, -n])
        else:
            floor = least[live]
        r, c = np.divmod(np.flatnonzero(some >= np.maximum(floor - np.float32(2e-6), np.finfo(np.float32).min)[:, None]), some.shape[1])
        news.append((live[r], c + a, some[r, c]))
        if sum(len(x[0]) for x in news) > m * n or a + tile >= len(ids) or np.isneginf(least).any():
            row, at, score = (np.concatenate(c) for c in zip((row, at, score), *news, strict=True))
            news = []
            order = np.lexsort((-score, row))
            row, at, score = row[order], at[order], score[order]
            begin = np.searchsorted(row, np.arange(m + 1))
            full = np.diff(begin) >= n
            least[full] = score[begin[:-1][full] + n - 1]
            keep = score >= least[row] - np.float32(2e-6)
            row, at, score = row[keep], at[keep], score[keep]
    if news:
        row, at, score = (np.concatenate(c) for c in zip((row, at, score), *news, strict=True))
    score = np.round(score, 6)
    order = np.lexsort((ids[at], -score, row))
    row, at, score = row[order], at[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < n], at[place < n], score[place < n]


def als_top(model, ratings: DataFrame, n: int = 500) -> DataFrame:
    """(user, item, score, rank): the n best unseen items of every user; ties by ascending item, scores to six places.

    Item factors are broadcast, ``FACTOR_BYTES`` at a time; every user is scored against all of them, and only the list leaves the task.
    """
    spark = ratings.sparkSession
    ship(spark)
    baskets = ratings.select("user", "item").distinct().groupBy("user").agg(F.collect_list(F.col("item").cast("bigint")).alias("items"))
    users = baskets.join(model.userFactors.select(F.col("id").alias("user"), "features"), "user").select(F.col("user").cast("bigint").alias("user"), "features", "items")
    norm = F.aggregate(F.transform("features", lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x)
    table = model.itemFactors.select(F.col("id").cast("bigint").alias("id"), "features", norm.alias("norm"))
    rank, count = model.rank, table.count()
    rounds = max(1, -(-count * rank * 4 // FACTOR_BYTES))
    most, tile = USERS, TILE
    if rounds > 1:
        users = written(users, "users")

    def scored(part: DataFrame) -> DataFrame:
        got = part.toArrow()
        ids = np.asarray(got.column("id"), dtype=np.int64)
        order = np.lexsort((ids, -np.asarray(got.column("norm"))))
        factors = got.column("features").combine_chunks()
        factors = np.asarray((pa.concat_arrays(factors.chunks) if isinstance(factors, pa.ChunkedArray) else factors).flatten(), dtype=np.float32).reshape(-1, rank)[order]
        shared = spark.sparkContext.broadcast((ids[order], factors, np.sqrt(np.asarray(got.column("norm"))[order])))

        def run(batches):
            ids, factors, norms = shared.value
            by_id = np.argsort(ids)
            for batch in batches:
                for a in range(0, len(batch), most):
                    some = batch.slice(a, most)
                    u = np.asarray(some.column(1).flatten(), dtype=np.float32).reshape(len(some), -1)
                    seen = []
                    for x in some.column(2):
                        x = np.asarray(x.values)
                        at = by_id[np.minimum(np.searchsorted(ids, x, sorter=by_id), len(ids) - 1)]
                        seen.append(at[ids[at] == x])
                    row, at, score = _best_unseen(u, seen, ids, factors, norms, n, tile)
                    place = np.arange(len(row)) - np.searchsorted(row, row) + 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(some.column(0))[row]), pa.array(ids[at]), pa.array(score), pa.array(place.astype(np.int32))], names=["user", "item", "score", "rank"])

        return users.mapInArrow(run, "user bigint, item bigint, score float, rank int")

    if count == 0:
        return spark.createDataFrame([], "user bigint, item bigint, score float, rank int")
    if rounds == 1:
        return scored(table)
    parts = [scored(table.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == k)) for k in range(rounds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = Window.partitionBy("user").orderBy(F.desc("score"), "item")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
