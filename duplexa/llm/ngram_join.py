"""N-gram Jaccard join by set relations.

Texts are sets of word shingles. Sets that are equal form a class, and only
classes are joined. Each set orders its shingles rarest first (by a bounded
count sketch of the corpus; the order changes the cost, never the answer) and
enters its prefix in the index: two sets that link share a prefix shingle.

Index lists are used twice. First every list answers for one member, its pivot:
each other member that sizes and positions allow is verified against it, and
what links takes over the pivot's answers, so a group of near copies costs one
verification a member and not one a pair. Then only lists that still span several
components are visited again, by their pivot, sorted by set size in blocks that sizes
and positions skip. Pairs are formed only across components, and compared only until
an answer found before has joined them. Every pair of sets that link is either
verified or known to be connected.

Before sets are sent anywhere, bitmaps of about one bit a shingle bound them: a bit is the
parity of its shingles, so two sets differ in as many shingles as their bitmaps do in
bits, or more. Pairs that differ in too many bits for a link are no candidates.

* Null texts count as empty. A set without words links with nothing and is its
  own component. A text of one to four words has one shingle, the whole sequence.
* Rows with null ids get n_shingles and a null component, and link nothing.
  Rows with equal ids are compared like any others; each keeps the result of
  its own text. Ties need no rule: the smallest id names the component.
* Input columns are not carried along, so none can clash. Empty tables give
  empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _exchange as X
from . import _text
from ._graph import components

SHINGLE, PERCENT = 5, 80
#: The sketch has 2**SKETCH_BITS counters of one byte, the logarithm of a count in steps of 1/STEPS: 4 MB at any size of the corpus.
SKETCH_BITS, BLOCK, STEPS = 22, 1 << 16, 8
#: A list that the sketch holds for longer is dealt to as many parts as it takes, each with a pivot of its own.
LIST_ROWS = 20_000
#: Sets of a block whose blocks are compared pairwise; a block of a list has at most ROWS_OF_SET times as many rows on average.
BLOCK_ROWS, ROWS_OF_SET = 4_096, 8
SLICE = 1 << 20
BUCKET = "__bucket"


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin."""
    w = _text.words(*_text.text_buffer(column))
    h, doc, n = w.hashes(lower=True), w.doc_of(), len(w.first) - 1
    at = w.inside(SHINGLE)
    keys, docs = [_text.window_hashes(h, SHINGLE)[at] if len(at) else h[:0]], [doc[at]]
    count = np.diff(w.first)
    for size in range(1, SHINGLE):
        short = np.flatnonzero(count == size)
        if len(short):
            keys.append(_text.window_hashes(h, size)[w.first[short]] ^ np.uint64(size))
            docs.append(short)
    key, doc = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[new], np.searchsorted(doc[new], np.arange(n + 1))


def set_keys(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set; 0 for empty ones."""
    total = np.zeros((2, len(tokens) + 1), np.uint64)
    np.cumsum(_text.mix(tokens + np.uint64(1)), out=total[0, 1:])
    np.cumsum(_text.mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), out=total[1, 1:])
    one, two = (np.diff(t[first]) for t in total)
    key = _text.mix(one ^ _text.mix(two + np.diff(first).astype(np.uint64))).view(np.int64)
    return np.where(np.diff(first) > 0, key, 0)


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _widths(size: np.ndarray) -> np.ndarray:
    """Bits of the bitmaps of sets: the power of two at or above their size, 64 at least."""
    return 1 << np.maximum(6, np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))


def bitmaps(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all sets' parity bitmaps, and where each one's begin."""
    size = np.diff(first)
    width = _widths(size)
    begin = np.concatenate([[0], np.cumsum(width)])
    place = (_text.mix(tokens ^ np.uint64(0xD6E8FEB86659FD93)) & np.repeat(width - 1, size).astype(np.uint64)).astype(np.int64) + np.repeat(begin[:-1], size)
    odd = np.bincount(place, minlength=int(begin[-1])).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little"), begin // 8


def _apart(one: np.ndarray, two: np.ndarray, n: np.ndarray, maps: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets, by number, differ in too many bits for a link. n: set sizes; maps: words of 64 bits of each set."""
    width = np.array([len(x) for x in maps])
    least = np.minimum(width[one], width[two])
    out = np.zeros(len(one), bool)
    for w in np.unique(least).tolist():
        mine = np.flatnonzero(least == w)
        own, at = np.unique(np.concatenate([one[mine], two[mine]]), return_inverse=True)
        # half of a bitmap folded onto the other is the bitmap of half the width
        folded = np.stack([np.bitwise_xor.reduce(maps[i].reshape(-1, w), axis=0) for i in own.tolist()])
        step = max(1, (1 << 20) // w)
        for k in range(0, len(mine), step):
            x, y = at[: len(mine)][k : k + step], at[len(mine) :][k : k + step]
            bits = np.bitwise_count(folded[x] ^ folded[y]).sum(axis=1, dtype=np.int64)
            some = mine[k : k + step]
            out[some] = bits * (100 + PERCENT) > (n[one[some]] + n[two[some]]) * (100 - PERCENT)
    return out


DESCRIBED = "id long, key long, n long, bits binary, block int, counts binary, cells binary, many binary"


def _describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each text (id, key, n, bits), and after each task's texts its counts of shingles by block."""

    def run(batches):
        names = [x.split()[0] for x in DESCRIBED.split(", ")]
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in _text.slices(batches, "__text", SLICE):
            tokens, first = shingle_sets(batch.column(1))
            np.add.at(counts, _cell(tokens), 1)
            maps, begin = bitmaps(tokens, first)
            raw, n = maps.tobytes(), batch.num_rows
            bits = pa.array([raw[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], pa.binary())
            none = pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(set_keys(tokens, first)), pa.array(np.diff(first)), bits, pa.nulls(n, pa.int32()), none, none, none], names=names)
        # counts of a byte, and those above by their number in the block
        counts = counts.reshape(-1, BLOCK)
        full = np.flatnonzero(counts.any(axis=1))
        high = [np.flatnonzero(counts[b] > 255) for b in full]
        nothing, none = pa.nulls(len(full), pa.int64()), pa.nulls(len(full), pa.binary())
        X.release()
        raw = [pa.array(x, pa.binary()) for x in ([np.minimum(counts[b], 255).astype(np.uint8).tobytes() for b in full], [h.astype(np.int32).tobytes() for h in high], [counts[b][h].tobytes() for b, h in zip(full, high, strict=True)])]
        yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, none, pa.array(full.astype(np.int32)), *raw], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, DESCRIBED)


def _sketch(described: DataFrame) -> np.ndarray:
    """The corpus's counts as logarithms, 4 MB whatever its size."""

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, x, cells, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(x, np.uint8).astype(np.int64)
                own[np.frombuffer(cells, np.int32)] = np.frombuffer(many, np.uint32)
                held[b] = held.get(b, 0) + own
        if held:
            codes = [np.minimum(np.round(STEPS * np.log2(1 + x)), 255).astype(np.uint8).tobytes() for x in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(codes, pa.binary())], names=["block", "codes"])

    blocks = described.where("block is not null").select("block", "counts", "cells", "many").repartition("block").mapInArrow(add, "block int, codes binary").collect()
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in blocks:  # at most 2**SKETCH_BITS / BLOCK rows
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["codes"], np.uint8)
    return out


def _index(docs: DataFrame, text_col: str, sketch, buckets: int, list_rows: int) -> DataFrame:
    """Prefix entries of every set, equal sets of a slice once: a row each, with its bucket of the index."""

    def run(batches):
        for batch in _text.slices(batches, "__text", SLICE):
            tokens, first = shingle_sets(batch.column(0))
            keys, size = set_keys(tokens, first), np.diff(first)
            _, own = np.unique(keys, return_index=True)  # one of each class in the slice
            mine = np.zeros(len(keys), bool)
            mine[own] = size[own] > 0
            doc = np.repeat(np.arange(len(keys)), size)
            codes = sketch.value[_cell(tokens)]
            order = np.lexsort(((codes.astype(np.uint64) << np.uint64(40)) | (tokens >> np.uint64(24)), doc))
            at = np.arange(len(tokens)) - first[doc]
            use = mine[doc] & (at < size[doc] - (PERCENT * size[doc] + 99) // 100 + 1)
            token, doc, at, codes = tokens[order][use], doc[use], at[use], codes[order][use]
            parts = ((np.exp2(codes / STEPS) - 1) // list_rows).astype(np.uint64) + np.uint64(1)
            salt = np.where(parts > 1, keys[doc].view(np.uint64) % parts + np.uint64(1), np.uint64(0))
            to = (_text.mix(token + salt) >> np.uint64(33)) % np.uint64(buckets)
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(token.view(np.int64)), pa.array(keys[doc]), pa.array((size[doc] << 32 | at).astype(np.int64)), pa.array(salt.astype(np.int32))], names=[BUCKET, "token", "key", "place", "salt"])
        X.release()

    return docs.select(F.col(text_col).alias("__text")).mapInArrow(run, f"{BUCKET} int, token long, key long, place long, salt int")


def _lists(table: pa.Table) -> pa.Table:
    """A bucket's index lists of two sets or more, each row with the list's pivot."""
    token, key, place, salt = (np.asarray(table.column(c)) for c in ("token", "key", "place", "salt"))
    n, at = place >> 32, place & 0xFFFFFFFF
    order = np.lexsort((key, salt, token))
    token, key, n, at, salt = (x[order] for x in (token, key, n, at, salt))
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
    token, key, n, at, salt = (x[new] for x in (token, key, n, at, salt))  # one of each class
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
    run = np.cumsum(new) - 1
    size = np.bincount(run)[run] if len(run) else run
    many = (size > 1) | (salt > 0)  # a part of a dealt list may hold one row and meet the others later
    token, key, n, at, salt, run = (x[many] for x in (token, key, n, at, salt, run))
    # the pivot is the set with the largest share of shingles in lists: the middle of a group of copies, not its edge
    _, which, shared = np.unique(key, return_inverse=True, return_counts=True)
    order = np.lexsort((key, -shared[which] / n, run))
    token, key, n, at, salt, run = (x[order] for x in (token, key, n, at, salt, run))
    new = np.ones(len(run), bool)
    new[1:] = run[1:] != run[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    columns = {"token": token, "key": key, "n": n, "at": at, "salt": salt, "pivot": key[head], "pivot_n": n[head], "pivot_at": at[head]}
    return pa.table({c: pa.array(x) for c, x in columns.items()})


LISTS = "token long, key long, n long, at long, salt int, pivot long, pivot_n long, pivot_at long"


def _possible(n, at, m, at2):
    """Whether sizes n, m and positions of a first common shingle allow a link. Works on Columns and arrays."""
    if isinstance(n, np.ndarray):
        return (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & ((100 + PERCENT) * np.minimum(n - at, m - at2) >= PERCENT * (n + m))
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & ((100 + PERCENT) * F.least(n - at, m - at2) >= PERCENT * (n + m))


def _sets(wanted: DataFrame, docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, tokens) of some classes, from one text of each."""
    texts = X.written(ids.join(wanted, "key").select(F.col("id").alias("__id"), "key"), "wanted")
    mine = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).join(X.small(texts), "__id")

    def run(batches):
        for batch in _text.slices(batches, "__text", SLICE):
            tokens, first = shingle_sets(batch.column(1))
            key = np.asarray(batch.column(2))
            own = np.flatnonzero(set_keys(tokens, first) == key)  # rows with equal ids may hold other texts
            yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array([tokens[first[i] : first[i + 1]].tobytes() for i in own], pa.binary())], names=["key", "tokens"])
        X.release()

    out = X.written(mine.mapInArrow(run, "key long, tokens binary").groupBy("key").agg(F.min("tokens").alias("tokens")), "sets")
    X.discard(texts)
    return out


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of classes (a, b) whose bitmaps allow a link."""
    c = F.col
    one, two = classes.select(c("key").alias("a"), c("n").alias("n"), c("bits").alias("x")), classes.select(c("key").alias("b"), c("n").alias("m"), c("bits").alias("y"))

    def run(batches):
        for batch in batches:
            k = batch.num_rows
            maps = [np.frombuffer(v.as_buffer(), np.uint64) for v in [*batch.column(3), *batch.column(5)]]
            n = np.concatenate([np.asarray(batch.column(2)), np.asarray(batch.column(4))])
            keep = pa.array(~_apart(np.arange(k), np.arange(k) + k, n, maps)) if k else pa.array([], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    both = pairs.join(one, "a").join(two, "b").select("a", "b", "n", "x", "m", "y")
    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of classes that link, by exact intersection of their sets."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("tokens").alias("y")), "b")

    def verify(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                if _linked(np.frombuffer(x.as_buffer(), np.uint64), [np.frombuffer(y.as_buffer(), np.uint64)])[0]:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return X.written(both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "links")


def _linked(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which sets (sorted, not empty) link with one."""
    size = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    common = np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)
    return 100 * common >= PERCENT * (len(one) + size - common)


def _cross_pairs(c: dict[str, np.ndarray], bits: dict[int, np.ndarray]) -> np.ndarray:
    """Pairs of keys within lists that sizes, positions and bitmaps allow and components do not join, those of most lists first."""
    order = np.lexsort((c["n"], c["token"]))
    token, key, n, at, root = (c[x][order] for x in ("token", "key", "n", "at", "root"))
    new = np.ones(len(order), bool)
    new[1:] = token[1:] != token[:-1]
    run = np.cumsum(new) - 1
    # within a list, the last row whose size a row's own still allows: what lies behind is skipped as a block
    span = int(n.max()) * 2 + 2
    last = np.searchsorted(run * span + n, run * span + n * 100 // PERCENT, "right") - 1
    names, which, local = np.unique(key, return_index=True, return_inverse=True)
    sizes, maps = n[which], [bits[k] for k in names.tolist()]
    codes, times, held, step, live = np.empty(0, np.int64), np.empty(0, np.int64), [], 1, np.arange(len(order))
    while True:
        live = live[live + step <= last[live]]
        if len(live):
            other = live + step
            ok = (root[live] != root[other]) & _possible(n[live], at[live], n[other], at[other])
            a, b = local[live[ok]], local[other[ok]]
            held.append(np.minimum(a, b) * len(names) + np.maximum(a, b))
            step += 1
        if held and (not len(live) or sum(map(len, held)) > 1 << 21):  # equal pairs of many lists are kept once
            fresh, often = np.unique(np.concatenate(held), return_counts=True)
            old = np.isin(fresh, codes)
            drop = np.zeros(len(fresh), bool)  # pairs that were apart before are looked at again
            drop[~old] = _apart(fresh[~old] // len(names), fresh[~old] % len(names), sizes, maps)
            codes, at_ = np.unique(np.concatenate([codes, fresh[~drop]]), return_inverse=True)
            times = np.bincount(at_, weights=np.concatenate([times, often[~drop]])).astype(np.int64)
            held = []
        if not len(live):
            break
    codes = codes[np.argsort(-times, kind="stable")]
    return np.stack([names[codes // len(names)], names[codes % len(names)]], 1)


def _parts(table: pa.Table):
    """The (home, part) groups of a bucket: row numbers."""
    home, part = np.asarray(table.column("home")), np.asarray(table.column("part"))
    order = np.lexsort((part, home))
    new = np.ones(len(order), bool)
    new[1:] = (home[order][1:] != home[order][:-1]) | (part[order][1:] != part[order][:-1])
    start = np.flatnonzero(new)
    for a, b in zip(start.tolist(), [*start[1:].tolist(), len(order)], strict=True):
        yield order[a:b]


def _needed(table: pa.Table) -> pa.Table:
    """(home, part, key) of the sets that are in any pair to be compared. Rows with bits tell the sets' bitmaps."""
    c = {x: np.asarray(table.column(x).fill_null(0)) for x in ("home", "part", "token", "key", "n", "at", "root")}
    is_map, maps = np.asarray(table.column("bits").is_valid()), table.column("bits")
    out = [[], [], []]
    for rows in _parts(table):
        bits = {int(c["key"][r]): np.frombuffer(maps[r].as_buffer(), np.uint64) for r in rows[is_map[rows]].tolist()}
        mine = rows[~is_map[rows]]
        keys = np.unique(_cross_pairs({k: v[mine] for k, v in c.items()}, bits))
        for o, v in zip(out, (np.full(len(keys), c["home"][rows[0]]), np.full(len(keys), c["part"][rows[0]]), keys), strict=True):
            o.append(v)
    home, part, key = (np.concatenate([np.empty(0, np.int64), *o]).astype(np.int64) for o in out)
    return pa.table({"home": home, "part": part.astype(np.int32), "key": key})


def _across(table: pa.Table) -> pa.Table:
    """Links of a bucket's groups, a pair being compared only while nothing found there has joined its components."""
    c = {x: np.asarray(table.column(x).fill_null(0)) for x in ("token", "key", "n", "at", "root")}
    is_set, tokens = np.asarray(table.column("tokens").is_valid()), table.column("tokens")
    found = []
    for rows in _parts(table):
        sets = {int(c["key"][r]): np.frombuffer(tokens[r].as_buffer(), np.uint64) for r in rows[is_set[rows]].tolist()}
        mine = rows[~is_set[rows]]
        if not len(mine):
            continue
        bits = {k: bitmaps(x, np.array([0, len(x)]))[0].view(np.uint64) for k, x in sets.items()}
        pairs = _cross_pairs({k: v[mine] for k, v in c.items()}, bits)
        keys, first = np.unique(c["key"][mine], return_index=True)
        roots, label, members = np.unique(c["root"][mine][first], return_inverse=True, return_counts=True)
        a, b = np.searchsorted(keys, pairs[:, 0]), np.searchsorted(keys, pairs[:, 1])
        swap = members[label[a]] > members[label[b]]  # the owner is of the smaller component
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        start = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.empty(0, np.int64)
        for s, e in zip(start.tolist(), [*start[1:].tolist(), len(a)], strict=True):
            own, left, width = a[s], b[s:e], 8
            while len(left := left[label[left] != label[own]]):
                some, left = left[:width], left[width:]
                width = min(width * 2, 512)
                yes = some[_linked(sets[int(keys[own])], [sets[int(keys[x])] for x in some])]
                for x in yes.tolist():
                    if label[x] != label[own]:
                        label[label == label[x]] = label[own]
                        found.append((int(keys[own]), int(keys[x])))
    one, two = zip(*found, strict=True) if found else ((), ())
    return pa.table({"a": pa.array(one, pa.int64()), "b": pa.array(two, pa.int64())})


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, list_rows: int = LIST_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, n_shingles, component_id) of every row: components of Jaccard similarity 0.8 or more over five-word shingles."""
    spark = docs.sparkSession
    X.ship(spark)
    buckets = buckets or X.group_count(docs, 2 * X.GROUP_BYTES)
    described = X.written(_describe(docs, id_col, text_col), "described")
    rows = described.where("block is null").select("id", "key", "n", "bits")
    sketch = spark.sparkContext.broadcast(_sketch(described))
    classes = X.written(rows.where("n > 0 and id is not null").groupBy("key").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("bits").alias("bits")), "classes")
    ids = classes.select("key", "id")
    known = docs.where(F.col(id_col).isNotNull())
    lists = _index(known, text_col, sketch, buckets, list_rows).groupBy(BUCKET).applyInArrow(_lists, LISTS)
    lists = X.written(lists, "lists")
    sketch.destroy()

    # a list answers for its pivot
    c = F.col
    star = lists.where((c("key") != c("pivot")) & _possible(c("n"), c("at"), c("pivot_n"), c("pivot_at"))).select("key", "pivot")
    heads = lists.where(c("key") == c("pivot")).groupBy("token").agg(F.min(F.struct("pivot", "pivot_n", "pivot_at")).alias("p"), F.max("salt").alias("parts")).where("parts > 0")
    dealt = lists.where(c("key") == c("pivot")).join(heads, "token").where((c("key") != c("p.pivot")) & _possible(c("n"), c("at"), c("p.pivot_n"), c("p.pivot_at"))).select("key", c("p.pivot").alias("pivot"))
    pairs = star.unionByName(dealt).select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct()
    pairs = X.written(_near(pairs, classes), "pairs")
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), docs, ids, id_col, text_col)
    links = _verified(pairs, sets)
    X.discard(pairs, sets)
    roots = components(links)

    # lists that span several components meet by their pivot, in blocks; only sets in a possible pair are sent
    home = lists.select("token", "key", "n", "at", c("pivot").alias("home"))
    if heads.limit(1).count():  # parts of a dealt list meet by the least of their pivots
        home = home.join(heads.select("token", c("p.pivot").alias("first")), "token", "left").withColumn("home", F.coalesce("first", "home")).drop("first")
    rooted = home.join(X.small(roots.withColumnRenamed("node", "key")), "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
    mixed = X.written(mixed, "tokens")
    rooted = X.written(rooted.join(X.small(mixed), "token", "left_semi").select("home", "token", "key", "n", "at", "root"), "mixed")
    X.discard(lists, mixed)
    of_key = rooted.groupBy("home", "key").agg(F.count("*").alias("rows"))
    blocks = of_key.groupBy("home").agg(F.ceil(F.greatest(F.count("*"), F.sum("rows") / ROWS_OF_SET) / block_rows).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("key"), c("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), c("blocks") - 1), lambda o: F.least(o, own) * c("blocks") + F.greatest(o, own))
    to = F.pmod(F.xxhash64("home", "part"), F.lit(buckets)).cast("int").alias(BUCKET)
    long = lambda name: F.lit(None).cast("long").alias(name)
    entries = rooted.join(blocks, "home").withColumn("part", F.explode(cells)).select(to, "home", "part", "token", "key", "n", "at", "root")
    maps = of_key.join(classes.select("key", "bits"), "key").join(blocks, "home").withColumn("part", F.explode(cells))
    maps = maps.select(to, "home", "part", long("token"), "key", long("n"), long("at"), long("root"), "bits")
    needed = entries.withColumn("bits", F.lit(None).cast("binary")).unionByName(maps).groupBy(BUCKET).applyInArrow(_needed, "home long, part int, key long")
    needed = X.written(needed, "needed")
    sets = _sets(needed.select("key").distinct(), docs, ids, id_col, text_col)
    sent = needed.join(sets, "key").select(to, "home", "part", long("token"), "key", long("n"), long("at"), long("root"), "tokens")
    entries = entries.join(needed, ["home", "part", "key"], "left_semi").withColumn("tokens", F.lit(None).cast("binary")).select(*sent.columns)
    more = X.written(entries.unionByName(sent).groupBy(BUCKET).applyInArrow(_across, "a long, b long"), "links")
    X.discard(rooted, needed, sets)
    roots = components(links.unionByName(more))
    X.discard(links, more)

    named = roots.join(ids.withColumnRenamed("key", "node"), "node")
    named = named.join(named.groupBy("root").agg(F.min("id").alias("low")), "root").select(c("node").alias("key"), "low")
    alone = rows.join(ids.withColumnRenamed("id", "__low"), "key", "left").join(named, "key", "left")
    component = F.when(c("id").isNull(), None).when(c("n") == 0, c("id")).otherwise(F.coalesce("low", "__low"))
    return alone.select(c("id").alias(id_col), c("n").alias("n_shingles"), component.alias("component_id"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
