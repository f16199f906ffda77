"""Neighbours and their items, block by block, without a shuffle of pairs.

Things that are compared (``x``) are dealt to blocks by a hash. A pivot's list goes once to each block that it touches, so
what is shuffled is bounded by edges times blocks, and never more than the pairs; pairs are formed, counted and ranked in
slices inside a block's task, and only the best leave it. Lists are packed: sorted, as differences, compressed.
"""

from __future__ import annotations

import itertools
import math
import pickle
import tempfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import cleaned, ship, written

#: Edges of a block, edges packed at a time, pairs formed at a time, and similarities a block of items holds at a time.
BLOCK, PACKED, SLICE, HELD = 3_000_000, 400_000, 1 << 18, 6_000_000
#: Cells of a table of similarities, the share of them from which a table is worth it, and parts of a blob's pairs by item.
CELLS, SHARE, POINTS = 96_000_000, 1 / 64, 1024
#: A similarity of 1 in a table, and rows added at a time: their product is below 1 << 16.
UNIT, ADDED = 512, 127
#: Blocks at least, so that a small cluster is busy.
LEAST = 12


def _block(ids: np.ndarray, blocks: int) -> np.ndarray:
    """Block of each id, alike where lists are sent and where they arrive."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % blocks


def _pack(*columns: np.ndarray) -> bytes:
    """Columns; integers as differences of the least width, byte planes apart."""
    out = []
    for c in columns:
        if c.dtype.kind == "i":
            d = np.diff(c, prepend=c.dtype.type(0))
            lo, hi = (int(d.min()), int(d.max())) if len(d) else (0, 0)
            kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= lo and hi <= np.iinfo(k).max)
            d = d.astype(kind)
            out.append((d.dtype.str, len(d), zlib.compress(np.ascontiguousarray(d.view(np.uint8).reshape(len(d), -1).T).tobytes(), 1)))
        else:
            out.append((c.dtype.str, len(c), zlib.compress(c.tobytes(), 1)))
    return pickle.dumps(out)


def _unpack(blob: bytes) -> list[np.ndarray]:
    out = []
    for kind, n, data in pickle.loads(blob):
        raw, kind = np.frombuffer(zlib.decompress(data), np.uint8), np.dtype(kind)
        if kind.kind == "i":
            out.append(np.cumsum(np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).view(kind).ravel(), dtype=np.int64))
        else:
            out.append(raw.view(kind))
    return out


def _flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each of some lists, one after the other."""
    end = np.cumsum(size)
    return np.arange(int(end[-1]) if len(end) else 0) + np.repeat(start - (end - size), size)


def _bounds(sorted_: np.ndarray) -> np.ndarray:
    """Where equal values begin, and the length."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.empty(0, np.int64), [len(sorted_)]])


def _slices(cost: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of things whose cost stays below ``most``; a dear thing is alone."""
    total, a = np.cumsum(cost), 0
    while a < len(cost):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _whole(batches: Iterator[pa.RecordBatch], packed: int) -> Iterator[list[np.ndarray]]:
    """Columns of many rows, sorted by the first; rows with the same first value stay together."""
    kept, n, most = [], 0, packed
    for batch in batches:
        kept.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += len(batch)
        if n >= most:
            columns = [np.concatenate(c) for c in zip(*kept, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            kept, n = [[c[cut:] for c in columns]], len(columns[0]) - cut
            most = max(packed, 2 * n)
            if cut:
                yield [c[:cut] for c in columns]
    if n:
        yield [np.concatenate(c) for c in zip(*kept, strict=True)]


def _task(run: Callable, *names: str):
    """``run`` on the blobs of each block of a task."""

    def go(batches):
        with tempfile.TemporaryFile() as spool:  # blocks are whole before they are worked on
            places: dict[int, list[tuple[int, int]]] = {}
            for batch in batches:
                for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    places.setdefault(k, []).append((spool.tell(), spool.write(blob.as_buffer())))

            def blobs(k):
                for at, n in places[k]:
                    spool.seek(at)
                    yield spool.read(n)

            for k in places:
                for columns in run(k, lambda k=k: blobs(k)):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list(names))

    return go


class Lists:
    """The lists of a block: places of each pivot's ids, ids by number, the id and degree of each number."""

    def __init__(self, blobs: Iterator[bytes], mine: Callable | None = None):
        """``mine`` tells which ids are the block's, where lists that hold none are to be passed over."""
        parts, sizes, degrees, lo, hi = [], [], [], 0, 0
        for _, size, ids, degree in map(_unpack, blobs):
            if mine is not None:
                touched = np.add.reduceat(mine(ids).astype(np.int64), np.cumsum(size) - size) > 0
                rows = np.repeat(touched, size)
                size, ids, degree = size[touched], ids[rows], degree[rows]
                if not len(ids):
                    continue
            lo, hi = min(lo, int(ids.min())), max(hi, int(ids.max()))
            parts.append(ids.astype(np.int32) if -(1 << 31) <= lo and hi < 1 << 31 else ids)
            sizes.append(size)
            degrees.append(degree.astype(np.min_scalar_type(int(degree.max()))))
        n = sum(map(len, parts))
        table = np.zeros(hi - lo + 1, bool) if hi - lo < max(n // 2, 1 << 20) else None
        if table is not None:
            for p in parts:
                table[p.astype(np.int64) - lo] = True
            self.values = np.flatnonzero(table) + lo
            number = np.cumsum(table, dtype=np.int32) - 1
        else:
            self.values = np.empty(0, np.int64)
            for p in parts:
                self.values = np.union1d(self.values, p)
        self.ids, self.degree = np.empty(n, np.int32), np.zeros(len(self.values), np.int64)
        at = 0
        for k, p in enumerate(parts):
            own = number[p.astype(np.int64) - lo] if table is not None else np.searchsorted(self.values, p)
            self.ids[at : at + len(p)] = own
            self.degree[own] = degrees[k]
            at += len(p)
            parts[k] = degrees[k] = None
        self.size = np.concatenate([*sizes, np.empty(0, np.int64)])
        self.start = np.cumsum(self.size) - self.size

    def pairs(self, mine: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(x, y, pivots in common) by x and y, of all x that are mine and all others y, a slice of x at a time."""
        at = np.flatnonzero(mine[self.ids])
        at = at[np.argsort(self.ids[at], kind="stable")]
        x, pivot = self.ids[at].astype(np.int64), np.searchsorted(self.start, at, "right") - 1
        begin = _bounds(x)
        cost = np.add.reduceat(self.size[pivot], begin[:-1]) if len(x) else np.empty(0, np.int64)
        n = len(self.values)
        for a, b in _slices(cost, most):
            a, b = int(begin[a]), int(begin[b])
            lists = pivot[a:b]
            if int(self.size[lists].sum()) > 2 * most:  # one x with very many pairs
                count = np.zeros(n, np.int64)
                for c, d in _slices(self.size[lists], most):
                    np.add.at(count, self.ids[_flat(self.start[lists[c:d]], self.size[lists[c:d]])], 1)
                count[x[a]] = 0
                y = np.flatnonzero(count)
                yield np.full(len(y), x[a]), y, count[y]
                continue
            size = self.size[lists]
            key = np.repeat(x[a:b] * n, size) + self.ids[_flat(self.start[lists], size)]
            key.sort()
            first = _bounds(key)
            key, count = key[first[:-1]], np.diff(first)
            one, two = key // n, key % n
            other = one != two
            yield one[other], two[other], count[other]


def _similarity(both: np.ndarray, one: np.ndarray, two: np.ndarray, total: int) -> np.ndarray:
    """1 - 1 / (1 + log likelihood), each different argument once; as ``functions.log_likelihood``, operation by operation."""
    m = int(max(one.max(initial=0), two.max(initial=0))) + 1
    most = (int(both.max(initial=0)) + 1) * m * m
    where = again = slice(None)
    if most <= 4 * len(both):
        key = (both * m + one) * m + two
        last = np.full(most, -1)
        last[key] = np.arange(len(key))
        different = np.flatnonzero(last >= 0)
        where = last[different]
        last[different] = np.arange(len(different))
        again = last[key]
    elif most < 1 << 62:
        _, where, again = np.unique((both * m + one) * m + two, return_index=True, return_inverse=True)
    both, one, two = both[where], one[where], two[where]
    k11, k12, k21, k22 = (c.astype(float) for c in (both, two - both, one - both, total - one - two + both))

    def xlogx(v):
        return np.where(v > 0, v * np.log(np.maximum(v, 1)), 0.0)

    rows, cols = xlogx(k11 + k12) + xlogx(k21 + k22), xlogx(k11 + k21) + xlogx(k12 + k22)
    cells = xlogx(k11) + xlogx(k12) + xlogx(k21) + xlogx(k22)
    llr = np.maximum(0.0, 2 * (cells - rows - cols + xlogx(k11 + k12 + k21 + k22)))
    return (1 - 1 / (1 + llr))[again]


def _similar(lists: Lists, mine: np.ndarray, total: int, min_support: int, most: int):
    for x, y, both in lists.pairs(mine, most):
        if min_support > 1:
            enough = both >= min_support
            x, y, both = x[enough], y[enough], both[enough]
        if len(x):  # numbers are in the order of ids: the smaller comes first, as in a pair
            dx, dy = lists.degree[x], lists.degree[y]
            yield x, y, _similarity(both, np.where(x < y, dx, dy), np.where(x < y, dy, dx), total)


def _best(x: np.ndarray, y: np.ndarray, score: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the n best of each x: by whole-numbered score, then y; rows are sorted by x and y."""
    own = _bounds(x)
    number = np.repeat(np.arange(len(own) - 1), np.diff(own))
    bits, top = max(1, len(x).bit_length()), int(score.max(initial=0))
    if len(own).bit_length() + bits + max(1, top.bit_length()) < 63:
        key = (number << (bits + top.bit_length())) | ((top - score) << bits) | np.arange(len(x))
        key.sort()
        order = key & ((1 << bits) - 1)
    else:
        order = np.lexsort((y, -score, number))
    place = np.arange(len(x)) - np.repeat(own[:-1], np.diff(own)) + 1
    keep = place <= n
    return order[keep], place[keep]


def _dealt(rows: DataFrame, pack, blocks: int) -> DataFrame:
    """Packed rows, one partition for each block."""
    packed = rows.repartition(rows.columns[0]).sortWithinPartitions(*rows.columns[:2]).mapInArrow(pack, "block int, blob binary")
    return packed.repartitionById(blocks, "block")


def _sender(blocks: int):
    """Packs lists of (pivot, x, degree) for the blocks they touch."""

    packed = PACKED

    def send(batches):
        for pivot, x, degree in _whole(batches, packed):
            begin = _bounds(pivot)
            size = np.diff(begin)
            home, number = _block(x, blocks), np.repeat(np.arange(len(size)), size)
            for k in range(blocks):
                touched = np.zeros(len(size), bool)
                touched[number[home == k]] = True
                rows = touched[number]
                if rows.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_pack(pivot[begin[:-1]][touched], size[touched], x[rows], degree[rows])], pa.binary())], names=["block", "blob"])

    return send


def stored(edges: DataFrame, x: str) -> DataFrame:
    """Distinct edges with the degree of x in a written table; null ends are dropped."""
    e = edges.select(F.col("user").cast("bigint").alias("user"), F.col("item").cast("bigint").alias("item")).na.drop()
    return written(e.repartition(x).distinct().withColumn("degree", F.count("*").over(Window.partitionBy(x))), "edges")


def near(seen: DataFrame, n: int, min_support: int = 1) -> DataFrame:
    """(x, y, similarity, place): the n nearest users of each by log-likelihood, of edges ``stored`` by user."""
    ship(seen.sparkSession)
    with cleaned(seen.sparkSession):
        edges, total = seen.agg(F.count("*"), F.count_distinct("item")).first()
    blocks, most = max(LEAST, math.ceil(edges / BLOCK)), SLICE

    def run(k, blobs):
        lists = Lists(blobs())
        for x, y, s in _similar(lists, _block(lists.values, blocks) == k, total, min_support, most):
            order, place = _best(x, y, np.rint(s * 1e9).astype(np.int64), n)
            yield lists.values[x[order]], lists.values[y[order]], s[order], place.astype(np.int32)

    rows = _dealt(seen.where(F.col("degree") >= min_support).select("item", "user", "degree"), _sender(blocks), blocks)
    return rows.mapInArrow(_task(run, "x", "y", "similarity", "place"), "x bigint, y bigint, similarity double, place int")


def by_users(seen: DataFrame, nearest: DataFrame, n: int) -> DataFrame:
    """(user, item, score, rank): the n best unseen items by the sum of the similarities of the users (x, y, similarity) that have them, of ``stored`` edges."""
    ship(seen.sparkSession)
    edges = seen.count()
    blocks, packed, most = max(LEAST, math.ceil(edges / BLOCK)), PACKED, SLICE

    def send(batches):
        """Items of y, and the x that look at them; y looks at its own, to leave them out."""
        for owner, kind, other, s in _whole(batches, packed):
            begin = _bounds(owner)
            number = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
            own = kind == 0
            owners, sizes = owner[begin[:-1]], np.bincount(number[own], minlength=len(begin) - 1)
            to = np.concatenate([np.arange(len(owners)), number[~own]])
            who, weight = np.concatenate([owners, other[~own]]), np.concatenate([np.full(len(owners), -1e9), s[~own]])
            home = _block(who, blocks)
            for k in range(blocks):
                here = np.flatnonzero(home == k)
                if len(here):
                    here = here[np.argsort(to[here], kind="stable")]
                    lists, at = np.unique(to[here], return_inverse=True)
                    touched = np.zeros(len(owners), bool)
                    touched[lists] = True
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_pack(sizes[lists], other[own & touched[number]], at.astype(np.int64), who[here], weight[here])], pa.binary())], names=["block", "blob"])

    def run(k, blobs):
        sizes, items, at, who, weight, before = [], [], [], [], [], 0
        for a, b, c, d, e in map(_unpack, blobs()):
            sizes.append(a)
            items.append(b.astype(np.int32) if -(1 << 31) <= b.min(initial=0) and b.max(initial=0) < 1 << 31 else b)
            at.append(c + before)
            who.append(d)
            weight.append(e)
            before += len(a)
        size, items, at, who, weight = (np.concatenate(c) for c in (sizes, items, at, who, weight))
        start = np.cumsum(size) - size
        order = np.argsort(who, kind="stable")
        at, who, weight = at[order], who[order], weight[order]
        begin = _bounds(who)
        for a, b in _slices(np.add.reduceat(size[at], begin[:-1]), most):
            x = np.repeat(np.arange(a, b), np.diff(begin[a : b + 1]))
            lists = slice(int(begin[a]), int(begin[b]))
            user, item = np.repeat(x, size[at[lists]]), items[_flat(start[at[lists]], size[at[lists]])].astype(np.int64)
            value = np.repeat(weight[lists], size[at[lists]])
            least = int(item.min(initial=0))
            width = int(item.max(initial=0)) - least + 1
            order = np.argsort((user - a) * width + (item - least), kind="stable") if (b - a) * width < 1 << 62 else np.lexsort((item, user))
            user, item, value = user[order], item[order], value[order]
            first = np.flatnonzero(np.concatenate([[True], (user[1:] != user[:-1]) | (item[1:] != item[:-1])])) if len(user) else np.empty(0, np.int64)
            score = np.add.reduceat(value, first) if len(first) else value
            fresh = first[score > -1e8]
            user, item, score = user[fresh], item[fresh], np.rint(score[score > -1e8] * 1e6).astype(np.int64)
            order, place = _best(user, item, score, n)
            yield who[begin[user[order]]], item[order], score[order] / 1e6, place.astype(np.int32)

    looks = nearest.select(F.col("y").alias("owner"), F.lit(1).alias("kind"), F.col("x").alias("other"), "similarity")
    rows = seen.select(F.col("user").alias("owner"), F.lit(0).alias("kind"), F.col("item").alias("other"), F.lit(0.0).alias("similarity")).unionByName(looks)
    return _dealt(rows, send, blocks).mapInArrow(_task(run, "user", "item", "score", "rank"), "user bigint, item bigint, score double, rank int")


def _packer():
    """Packs whole lists of (pivot, x, degree)."""
    packed = PACKED

    def pack(batches):
        for pivot, x, degree in _whole(batches, packed):
            begin = _bounds(pivot)
            yield pa.RecordBatch.from_arrays([pa.array([_pack(pivot[begin[:-1]], np.diff(begin), x, degree)], pa.binary())], names=["blob"])

    return pack


def _ranges(baskets: DataFrame) -> tuple[int, int, np.ndarray]:
    """(users, blocks, last id of each block but the last): ranges of items with about as many pairs each, of packed baskets."""
    points, block, least = POINTS, BLOCK, LEAST

    def sums(batches):
        """Items that cut a blob's pairs to equal parts, with their part."""
        for batch in batches:
            for blob in batch.column(0):
                _, size, items, _ = _unpack(blob.as_buffer())
                order = np.argsort(items)
                total = np.cumsum(np.repeat(size, size)[order])
                at = np.unique(np.searchsorted(total, np.linspace(0, total[-1], points + 1)[1:]))
                yield pa.RecordBatch.from_arrays([pa.array(items[order][at]), pa.array(np.diff(total[at], prepend=0)), pa.array([len(size)] + [0] * (len(at) - 1)), pa.array([len(items)] + [0] * (len(at) - 1))], names=["item", "pairs", "users", "edges"])

    got = baskets.mapInArrow(sums, "item bigint, pairs bigint, users bigint, edges bigint").toArrow()
    item, pairs, users, edges = (c.to_numpy() for c in got.columns)
    blocks = max(least, math.ceil(int(edges.sum()) / block))
    order = np.argsort(item)
    total = np.cumsum(pairs[order])
    cuts = item[order][np.searchsorted(total, total[-1] * np.arange(1, blocks) / blocks)] if len(item) else item
    return int(users.sum()), blocks, np.unique(cuts)


def _met(size: np.ndarray, home: np.ndarray, blocks: int) -> np.ndarray:
    """Blocks that each list touches."""
    met = np.zeros((len(size), blocks), bool)
    met[np.repeat(np.arange(len(size)), size), home] = True
    return met


def _reach(baskets: DataFrame, cuts: np.ndarray, blocks: int) -> np.ndarray:
    """Blocks that share a basket: only from there can an item be like one of the block's."""

    def shared(batches):
        reach = np.zeros((blocks, blocks), bool)
        for batch in batches:
            for blob in batch.column(0):
                _, size, items, _ = _unpack(blob.as_buffer())
                met = np.unique(np.packbits(_met(size, np.searchsorted(cuts, items), blocks), axis=1), axis=0)
                met = np.unpackbits(met, axis=1, count=blocks).astype(np.float32)
                reach |= met.T @ met > 0
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(reach).tobytes()], pa.binary())], names=["reach"])

    def joined(batches):
        reach = np.packbits(np.eye(blocks, dtype=bool))
        for batch in batches:
            for some in batch.column(0):
                reach |= np.frombuffer(some.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([reach.tobytes()], pa.binary())], names=["reach"])

    reach = baskets.mapInArrow(shared, "reach binary").repartition(1).mapInArrow(joined, "reach binary").first()["reach"]
    return np.unpackbits(np.frombuffer(reach, np.uint8), count=blocks * blocks).reshape(blocks, blocks) > 0


class Table:
    """Similarities of some of a block's items (columns) to all items (rows) as whole numbers; sums of rows bound a score, so few are added exactly."""

    def __init__(self, rows: np.ndarray, width: int, col: np.ndarray, y: np.ndarray, s: np.ndarray, values: int):
        self.row = np.full(values, -1, np.int64)
        self.row[rows] = np.arange(len(rows))
        self.width = width
        low = max(1, round(float(s.min()) * UNIT))
        self.least, self.error = low, 0.5 if low > 1 else 1.0
        self.cells, some = np.empty((len(rows), -(-width // 32) * 32), np.uint16), np.zeros(32 * len(rows), np.uint16)
        # bits of the rows of each column, and the pairs before each 64 of them
        self.words, self.s = -(-len(rows) // 64), s
        self.bits, self.before = np.zeros(width * self.words, np.uint64), np.zeros(width * self.words, np.int32)
        begin = np.searchsorted(col, np.arange(0, width + 32, 32)).tolist()
        for k, (a, b) in enumerate(itertools.pairwise(begin)):
            c, place = col[a:b].astype(np.int64), self.row[y[a:b]]
            at = place * 32 + (c & 31)
            some[at] = np.maximum(np.rint(s[a:b] * UNIT), 1)
            self.cells[:, 32 * k : 32 * k + 32] = some.reshape(-1, 32)
            some[at] = 0
            word = c * self.words + (place >> 6)
            first = _bounds(word)[:-1]
            if len(first):
                self.bits[word[first]] = np.bitwise_or.reduceat(np.uint64(1) << (place & 63).astype(np.uint64), first)
                self.before[word[first]] = a + first

    def scores(self, number, length, column, least, n, most):
        """(user, column, score) of all that can be among the n best of a user; ``least`` is what a score must reach."""
        user = np.repeat(np.arange(len(length)), length)
        seen = np.flatnonzero((column >= 0) & (column < self.width))
        row = self.row[number]
        at = np.flatnonzero(row >= 0)
        row, user_, user = row[at], user[seen], user[at]
        begin = _bounds(user)
        live, begin, wide = user[begin[:-1]], begin.tolist(), self.cells.shape[1]
        buffer, found = np.empty((ADDED, wide), np.uint16), []
        many = max(1, most // wide)
        for a in range(0, len(live), many):
            b = min(a + many, len(live))
            count = np.diff(begin[a : b + 1])
            sums = np.zeros((b - a, wide), np.uint16 if count.max() <= ADDED else np.int64)
            for k in range(a, b):
                if begin[k + 1] - begin[k] <= ADDED:
                    part = buffer[: begin[k + 1] - begin[k]]
                    np.take(self.cells, row[begin[k] : begin[k + 1]], axis=0, out=part, mode="clip")
                    np.add.reduce(part, axis=0, dtype=sums.dtype, out=sums[k - a])
                else:
                    for c in range(begin[k], begin[k + 1], ADDED):
                        sums[k - a] += np.add.reduce(self.cells[row[c : min(c + ADDED, begin[k + 1])]], axis=0, dtype=np.uint16)
            own = slice(*np.searchsorted(user_, [live[a], live[b - 1] + 1]))
            who = np.searchsorted(live[a:b], user_[own])
            here = live[a:b][np.minimum(who, b - a - 1)] == user_[own]
            sums[who[here], column[seen[own]][here]] = 0
            top = sums.reshape(b - a, 32, -1).max(1)  # the n-th best maximum is no better than the n-th best sum
            error = self.error * np.minimum(count, top.max(1) // self.least)
            floor = np.partition(top, -n, axis=1)[:, -n] - 2 * error if top.shape[1] >= n else np.zeros(b - a)
            floor = np.ceil(np.maximum(np.maximum(floor, least[live[a:b]] * UNIT - error) - 1, 1))
            floor = np.minimum(floor, np.iinfo(sums.dtype).max).astype(sums.dtype)
            who, group = np.nonzero(top >= floor[:, None])
            at, k = np.nonzero(sums.reshape(b - a, 32, -1)[who, :, group] >= floor[who, None])
            found.append((who[at] + a, k * (wide // 32) + group[at]))
        if not found:
            return
        who, col = (np.concatenate(c) for c in zip(*found, strict=True))
        begin = np.asarray(begin)
        size = np.diff(begin)[who]
        for a, b in _slices(size, most):
            of = np.repeat(np.arange(b - a), size[a:b])
            r = row[_flat(begin[who[a:b]], size[a:b])]
            word, bit = np.repeat(col[a:b] * self.words, size[a:b]) + (r >> 6), (r & 63).astype(np.uint64)
            bits = self.bits[word] >> bit
            some = np.flatnonzero(bits & np.uint64(1))
            word, bit = word[some], bit[some]
            at = self.before[word] + np.bitwise_count(self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            yield live[who[a:b]], col[a:b], np.bincount(of[some], self.s[at], b - a)


class Sparse:
    """The same of items that have little in common: what is met is added one by one."""

    def __init__(self, width: int, col: np.ndarray, y: np.ndarray, s: np.ndarray, values: int):
        order = np.argsort(y, kind="stable")
        self.x, self.s, self.width = col[order], s[order], width
        self.size = np.bincount(y, minlength=values)
        self.start = np.cumsum(self.size) - self.size
        self.cells, self.last = np.zeros(width), np.empty(width, np.int64)

    def scores(self, number, length, column, least, n, most):
        first, width = np.cumsum(length) - length, self.width
        met = np.add.reduceat(self.size[number], first)
        live = np.flatnonzero(met)
        for a, b in _slices(met[live] + width // 8, most):
            who = live[a:b]
            items = _flat(first[who], length[who])
            of, m = np.repeat(np.arange(b - a), length[who]), (b - a) * width
            if m > len(self.cells):
                self.cells, self.last = np.zeros(m), np.empty(m, np.int64)
            numbers, total = number[items], int(met[who].sum())
            if total > 2 * most:  # one user with very many items
                for c, d in _slices(self.size[numbers], most):
                    at = _flat(self.start[numbers[c:d]], self.size[numbers[c:d]])
                    self.cells[:m] += np.bincount(self.x[at], self.s[at], m)
                key = np.flatnonzero(self.cells[:m])
            else:
                size = self.size[numbers]
                at = _flat(self.start[numbers], size)
                key = np.repeat(of * width, size) + self.x[at]
                np.add.at(self.cells, key, self.s[at])
                self.last[key] = np.arange(len(key))
                key = key[self.last[key] == np.arange(len(key))]
            score = self.cells[key]
            self.cells[key] = 0
            good = score >= least[who[key // width]] - 2e-6
            key, score = key[good], score[good]
            seen = (column[items] >= 0) & (column[items] < width)
            good = ~np.isin(key, of[seen] * width + column[items][seen])
            yield who[key[good] // width], key[good] % width, score[good]


def _tables(first: int, width: int, col: np.ndarray, y: np.ndarray, s: np.ndarray, values: int, cells: int, share: float):
    """(first column, table) of pairs sorted by column; one with too many cells is halved."""
    if not len(s):
        return
    met = np.zeros(values, bool)
    met[y] = True
    rows = np.flatnonzero(met)
    if len(s) < share * len(rows) * width:
        yield first, Sparse(width, col, y, s, values)
    elif len(rows) * width <= cells or width == 1:
        yield first, Table(rows, width, col, y, s, values)
    else:
        half = width // 2
        m = int(np.searchsorted(col, half))
        yield from _tables(first, half, col[:m], y[:m], s[:m], values, cells, share)
        yield from _tables(first + half, width - half, col[m:] - half, y[m:], s[m:], values, cells, share)


def by_items(seen: DataFrame, n: int, min_support: int = 1) -> DataFrame:
    """(user, item, score, rank): the n best unseen items by the sum of their similarities to the user's, of edges ``stored`` by item.

    Blocks are ranges of items. A basket goes to the blocks that its own blocks share baskets with; there, similarities of some
    items at a time meet the baskets, and the n best so far are kept. The best of each block are ranked again.
    """
    spark = seen.sparkSession
    ship(spark)
    baskets = written(seen.select("user", "item", "degree").repartition("user").sortWithinPartitions("user", "item").mapInArrow(_packer(), "blob binary"), "baskets")
    total, blocks, cuts = _ranges(baskets)
    reach = _reach(baskets, cuts, blocks)
    most, held, cells, share = SLICE, HELD, CELLS, SHARE

    def send(batches):
        for batch in batches:
            for blob in batch.column(0):
                users, size, items, degree = _unpack(blob.as_buffer())
                if min_support > 1:
                    enough = degree >= min_support
                    size = np.add.reduceat(enough.astype(np.int64), np.cumsum(size) - size)
                    users, size, items, degree = users[size > 0], size[size > 0], items[enough], degree[enough]
                met = _met(size, np.searchsorted(cuts, items), blocks).astype(np.float32) @ reach.astype(np.float32) > 0
                for k in np.flatnonzero(met.any(0)).tolist():
                    rows = np.repeat(met[:, k], size)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_pack(users[met[:, k]], size[met[:, k]], items[rows], degree[rows])], pa.binary())], names=["block", "blob"])

    def run(k, blobs):
        lists = Lists(blobs(), lambda ids: np.searchsorted(cuts, ids) == k)
        values = lists.values
        mine = np.searchsorted(cuts, values) == k
        own = np.flatnonzero(mine)  # the block's items, in order
        if not len(own):
            return
        column = np.where(mine, np.cumsum(mine) - 1, -1)
        at = np.flatnonzero(mine[lists.ids])
        cost = np.bincount(lists.ids[at], lists.size[np.searchsorted(lists.start, at, "right") - 1], len(values))[own].astype(np.int64)
        cost = np.minimum(cost, len(values))
        with tempfile.TemporaryFile() as spool, tempfile.TemporaryFile() as best:
            chunks, users = [], 0  # baskets as numbers, without what is like none of the block's items
            for who, length, ids, _ in map(_unpack, blobs()):
                number = np.minimum(np.searchsorted(values, ids), len(values) - 1)
                known = values[number] == ids
                length = np.add.reduceat(known.astype(np.int64), np.cumsum(length) - length)
                who, length = who[length > 0], length[length > 0]
                if len(who):
                    chunks.append((spool.tell(), users, who, length))
                    spool.write(number[known].astype(np.int32).tobytes())
                    users += len(who)
            spool.flush()
            best.truncate(max(1, users) * n * 16)
            score, item = np.memmap(best, np.int64, "r+", 0, (users, n)), np.memmap(best, np.int64, "r+", users * n * 8, (users, n))
            score[:] = -1
            for a, b in _slices(cost, held):
                mine = np.zeros(len(values), bool)
                mine[own[a:b]] = True
                room, m = int(cost[a:b].sum()), 0
                col, y, s = np.empty(room, np.int32), np.empty(room, np.int32), np.empty(room)
                for x_, y_, s_ in _similar(lists, mine, total, min_support, most):
                    col[m : m + len(x_)], y[m : m + len(x_)], s[m : m + len(x_)] = column[x_] - a, y_, np.maximum(s_, 1e-15)  # a similarity of 0 counts as met all the same
                    m += len(x_)
                for c, table in _tables(a, b - a, col[:m], y[:m], s[:m], len(values), cells, share):
                    for place, start, who, length in chunks:
                        spool.seek(place)
                        number = np.frombuffer(spool.read(4 * int(length.sum())), np.int32)
                        old = score[start : start + len(who)]
                        news = [(u, own[x + c], np.rint(v * 1e6).astype(np.int64)) for u, x, v in table.scores(number, length, column[number] - c, old[:, -1] / 1e6, n, most)]
                        if not news:
                            continue
                        u, i, v = (np.concatenate(x) for x in zip(*news, strict=True))
                        row, place_ = np.nonzero(old >= 0)
                        u, i, v = np.concatenate([u, row]), np.concatenate([values[i], item[start + row, place_]]), np.concatenate([v, old[row, place_]])
                        order = np.lexsort((i, -v, u))
                        u, i, v = u[order], i[order], v[order]
                        begin = _bounds(u)
                        rank = np.arange(len(u)) - np.repeat(begin[:-1], np.diff(begin))
                        keep = rank < n
                        score[start + u[keep], rank[keep]], item[start + u[keep], rank[keep]] = v[keep], i[keep]
                    del table  # before the next is made
                del col, y, s
            for _, start, who, _ in chunks:
                row, place = np.nonzero(score[start : start + len(who)] >= 0)
                yield who[row], np.asarray(item[start + row, place]), score[start + row, place] / 1e6

    rows = baskets.mapInArrow(send, "block int, blob binary").repartitionById(blocks, "block")
    found = rows.mapInArrow(_task(run, "user", "item", "score"), "user bigint, item bigint, score double")
    order = Window.partitionBy("user").orderBy(F.desc("score"), "item")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
