"""Embedding near-dedup by a PCA-ordered, tiled comparison.

Vectors are scaled to length one and turned to the axes of a PCA, largest
variance first. A pair's cosine is accumulated over the axes, a quarter of them at a time; what the rest
can add is at most the product of the two suffix norms, so a pair stops as soon
as that cannot reach the threshold, and a tile as soon as all its pairs have.
Pairs that remain are decided on the original vectors in double precision.

All pairs of blocks are compared, so a vector is shuffled once for each block. Blocks are
few and large: as many as keep the tasks busy while the table is small, of 65,536 vectors beyond that.
Single-precision vectors are shuffled as they are.

Equal vectors form one class. A pair of blocks returns, for each class in it, how
many vectors it links to and one edge to the least class it is connected with
there: rows in proportion to the classes, however many pairs link.

* Vectors that are null or zero, or hold null or non-finite components, link with
  nothing; so do rows with a null id, whose component and kept are null. Vectors
  of different lengths are not compared.
* Repeated rows are vectors like others (equal vectors link). The smallest id
  names a component, so ties need no rule. Empty tables give empty results.
* Input columns other than the id are not carried along, so none can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _exchange as X
from ._graph import components

THRESHOLD = 0.95
#: The axes are fitted on at most this many vectors, those with the smallest hash; every vector is compared.
MOST_FITTED = 10_000
TILE = 1024
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 2_048, 65_536, 8
_SLACK = 1e-9


def axes(sample: np.ndarray) -> np.ndarray:
    """Orthonormal axes by descending second moment."""
    unit = sample / np.linalg.norm(sample, axis=1)[:, None]
    values, vectors = np.linalg.eigh(unit.T @ unit)
    return vectors[:, np.argsort(-values, kind="stable")]


class _Block:
    """Vectors of a block in the order of their first axis, with suffix norms at each step."""

    def __init__(self, raw: bytes, key: bytes, size: bytes, turn: np.ndarray, steps: list[int], single: bool):
        v = np.frombuffer(raw, np.float32 if single else np.float64).reshape(-1, len(turn)).astype(np.float64)
        self.key, self.size = np.frombuffer(key, np.int64), np.frombuffer(size, np.int64)
        v /= np.abs(v).max(axis=1)[:, None]  # squares neither overflow nor vanish
        v /= np.linalg.norm(v, axis=1)[:, None]
        order = np.argsort(v @ turn[:, 0], kind="stable")
        self.key, self.size, self.unit = self.key[order], self.size[order], v[order]
        self.turned = self.unit @ turn
        self.rest = np.stack([np.linalg.norm(self.turned[:, k:], axis=1) for k in steps], 1)

    def tiles(self, lead: int):
        for a in range(0, len(self.key), TILE):
            part = self.turned[a : a + TILE, :lead]
            yield a, min(a + TILE, len(self.key)), part.min(0), part.max(0)


def _products(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows of x and y, a bounded number at a time."""
    return np.concatenate([np.empty(0), *[np.einsum("ij,ij->i", x[i[s : s + 65536]], y[j[s : s + 65536]]) for s in range(0, len(i), 65536)]])


def linked(one: _Block, two: _Block, steps: list[int], threshold: float, same: bool):
    """(row of one, row of two) arrays of the pairs that link, tile by tile."""
    far = 2 - 2 * threshold + _SLACK  # squared distance at which a pair cannot link
    right, lead = list(two.tiles(steps[0])), steps[0]
    for a, b, low, high in one.tiles(lead):
        for c, d, low2, high2 in right:
            if same and d <= a:
                continue
            gap = np.maximum(0, np.maximum(low - high2, low2 - high))
            if gap @ gap > far:
                continue
            dot = one.turned[a:b, :lead] @ two.turned[c:d, :lead].T
            i, j = np.nonzero(dot + np.outer(one.rest[a:b, 0], two.rest[c:d, 0]) >= threshold - _SLACK)
            if same:
                later = i + a < j + c
                i, j = i[later], j[later]
            dot, i, j = dot[i, j], i + a, j + c
            for s in range(1, len(steps)):
                if not len(i):
                    break
                dot += _products(one.turned[:, steps[s - 1] : steps[s]], i, two.turned[:, steps[s - 1] : steps[s]], j)
                keep = dot + one.rest[i, s] * two.rest[j, s] >= threshold - _SLACK
                i, j, dot = i[keep], j[keep], dot[keep]
            if len(i):
                keep = _products(one.unit, i, two.unit, j) >= threshold
                yield i[keep], j[keep]


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` (of each row, the least row it is connected with) after more links; nothing of them is kept."""
    while True:
        x, y = label[i], label[j]
        apart = x != y
        if not apart.any():
            return label
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _compare(classes: DataFrame, dim: int, turn: np.ndarray, threshold: float, total: int, block: int | None, single: bool) -> DataFrame:
    """(cid, links, other): for classes that link within a pair of blocks, how many vectors, and an edge."""
    rows = block or max(LEAST_BLOCK, min(MOST_BLOCK, -(-total // BLOCKS)))
    blocks = -(-total // rows)
    steps = sorted({max(1, dim // 4), max(1, dim // 2), max(1, 3 * dim // 4)})

    def gather(key, table):
        v = np.asarray(table.column("v").combine_chunks().flatten(), dtype=np.float32 if single else np.float64)
        return pa.table({"b": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([v.tobytes()], pa.binary()), "key": pa.array([np.asarray(table.column("cid"), dtype=np.int64).tobytes()], pa.binary()), "size": pa.array([np.asarray(table.column("size"), dtype=np.int64).tobytes()], pa.binary())})

    dealt = classes.select("cid", "v", "size", F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("int").alias("b"))
    packed = X.written(dealt.groupBy("b").applyInArrow(gather, "b int, v binary, key binary, size binary"), "blocks")
    cells = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.least(o, F.col("b")) * blocks + F.greatest(o, F.col("b")))
    dealt = packed.withColumn("cell", F.explode(cells))

    def compare(key, table):
        parts = [_Block(v, k, s, turn, steps, single) for v, k, s in sorted(zip(*(table.column(c).to_pylist() for c in ("v", "key", "size")), strict=True), key=lambda x: x[1])]
        same = key[0].as_py() // blocks == key[0].as_py() % blocks
        one, two = parts[0], parts[-1]
        shift = 0 if same else len(one.key)
        keys, sizes = (one.key, one.size) if same else (np.concatenate([one.key, two.key]), np.concatenate([one.size, two.size]))
        links, label = np.zeros(len(keys), np.int64), np.arange(len(keys))
        if same or len(parts) == 2:
            for i, j in linked(one, two, steps, threshold, same):
                j = j + shift
                np.add.at(links, i, sizes[j])
                np.add.at(links, j, sizes[i])
                label = _join(label, i, j)
        hit = links > 0
        return pa.table({"cid": pa.array(keys[hit]), "links": pa.array(links[hit]), "other": pa.array(keys[label[hit]])})

    return dealt.groupBy("cell").applyInArrow(compare, "cid long, links long, other long")


def dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block: int | None = None, most_fitted: int = MOST_FITTED) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    X.ship(vectors.sparkSession)
    c = F.col
    kind = vectors.schema[vector_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = vectors.select(c(id_col).alias("id"), (c(vector_col) if single else c(vector_col).cast("array<double>")).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # equal numbers are equal vectors: -0.0 becomes 0.0
    rows = rows.withColumn("ok", F.coalesce(c("id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    rows = rows.withColumn("v", F.when(c("ok"), F.transform("v", lambda x: x + F.lit(0.0).cast("float" if single else "double"))))
    grouped = rows.where("ok").groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("size"))
    classes = X.written(grouped.select(F.monotonically_increasing_id().alias("cid"), "v", "low", "size", F.size("v").alias("dim")), "classes")
    parts = []
    for r in classes.groupBy("dim").count().orderBy("dim").collect():  # one row for each length of vectors
        mine = classes.where(c("dim") == r["dim"])
        sample = mine.select("v").orderBy(F.xxhash64("v"), "v").limit(most_fitted).collect()
        sample = np.array([x["v"] for x in sample])
        turn = axes(sample / np.abs(sample).max(axis=1)[:, None])
        parts.append(_compare(mine, r["dim"], turn, threshold, r["count"], block, single))
    found = parts[0] if parts else vectors.sparkSession.createDataFrame([], "cid long, links long, other long")
    for p in parts[1:]:
        found = found.unionByName(p)
    found = X.written(found, "links")
    roots = components(found.select(c("cid").alias("a"), c("other").alias("b")))
    named = roots.join(classes.select(c("cid").alias("node"), "low"), "node")
    named = named.join(named.groupBy("root").agg(F.min("low").alias("least")), "root").select(c("node").alias("cid"), "least")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    known = classes.join(links, "cid", "left").join(named, "cid", "left").select("v", (F.coalesce("links", F.lit(0)) + c("size") - 1).alias("n_links"), F.coalesce("least", "low").alias("component_id"))
    valid = rows.where("ok").join(known, "v").select("id", "n_links", "component_id")
    rest = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), c("id").alias("component_id"))
    out = valid.unionByName(rest)
    return out.select(c("id").alias(id_col), "n_links", c("component_id").cast("long").alias("component_id"), (c("id") == c("component_id")).alias("kept"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
