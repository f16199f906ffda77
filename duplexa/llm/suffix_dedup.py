"""Suffix-array dedup: repeated byte strings of 400 or more, by a Burrows-Wheeler transform.

``repeated_starts`` sorts suffixes, takes the transform and extends intervals
backward, breadth first. An interval of length l whose right edge is new shows
a common prefix of l - 1 there, so prefixes come out by increasing value; the
walk stops at the minimum length, and what no edge separates by then repeats.

A corpus is cut for it by content. A window of 400 bytes is assigned to the
200-byte gram in it with the least hash, so equal windows get equal grams,
wherever they are; neighbouring windows with one gram form a segment. Equal
segments are one kind: all windows of a kind that occurs twice repeat. Where a gram has
several kinds, one segment of each goes through the transform of the gram's bucket. A gram with
more than ``HOT`` kinds is split to single windows, which are counted: no transform holds
an unbounded group.

* Null texts count as empty; texts under 400 bytes lose nothing. Ids play no
  part: rows with null or equal ids, and repeated rows, are
  separate documents, and a repeated row repeats everything.
* With ``keep_first`` a string stays where it starts first, in the order of the table's rows
  and then of the text, and goes everywhere else.
* Strings overlap freely and are judged on the input. Empty tables give empty
  results. A text is handled in pieces of half a MB, so length is no limit.
* The input must be a stored table (see ``in_groups``). Its columns are kept unless a result
  column has their name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _exchange as X
from . import _text

LENGTH, GRAM = 400, 200
#: Kinds of segments of one gram that go through one transform (about 2 MB).
HOT = 4_096
#: Bytes of text in one transform, and in one piece of a group.
UNIT, PIECE = 1 << 20, 1 << 19
_MARK = 0xFF  # no byte of UTF-8

RESULT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType())])


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of ``text`` sorted by their first ``depth`` bytes at least, by doubling the unresolved ones."""
    n = len(text)
    around = np.concatenate([text, np.resize(text, 8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | around[i : i + n]
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(n, np.int64)
    slot, done = np.arange(n), 8
    rank[order] = np.maximum.accumulate(np.where(new, slot, 0))
    while done < depth:
        alone = new & np.append(new[1:], True)
        slot = slot[~alone]
        if not len(slot):
            break
        at = order[slot]
        key = (rank[at] << 32) | rank[(at + done) % n]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slot] = at
        new = np.ones(len(slot), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(new, slot, 0))
        done *= 2
    return order


def repeated_starts(text: np.ndarray, length: int = LENGTH, rank: np.ndarray | None = None) -> np.ndarray:
    """For each rotation of ``text``, whether its first ``length`` bytes start another one too; with a rank, one of lower rank."""
    n = len(text)
    if n < 2:
        return np.zeros(n, bool)
    order = suffix_order(text, length)
    bwt = text[order - 1]
    back = np.empty(n, np.int64)
    back[np.argsort(bwt, kind="stable")] = np.arange(n)
    # the sort's first 8 bytes (or fewer) give the first intervals
    level = min(8, length)
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    for i in range(level):
        byte = text[(order + i) % n]
        known[1:n] |= byte[1:] != byte[:-1]
    # equal neighbours in the transform move together, so intervals are taken by its runs
    head = np.ones(n, bool)
    head[1:] = bwt[1:] != bwt[:-1]
    run_of, run_at = np.cumsum(head) - 1, np.append(np.flatnonzero(head), n)
    low = np.flatnonzero(known[:n])
    stop = np.append(low[1:], n)
    while level < length and len(low):
        level += 1
        first = run_of[low]
        runs = run_of[stop - 1] - first + 1
        which = np.repeat(np.arange(len(low)), runs)
        run = np.arange(len(which)) + np.repeat(first - np.cumsum(runs) + runs, runs)
        at = np.maximum(run_at[run], low[which])
        count = np.minimum(run_at[run + 1], stop[which]) - at
        to = back[at]
        by = np.argsort(to)
        to, which, count, byte = to[by], which[by], count[by], bwt[at[by]]
        head = np.ones(len(to), bool)
        head[1:] = (which[1:] != which[:-1]) | (byte[1:] != byte[:-1]) | (to[1:] != to[:-1] + count[:-1])
        start = np.flatnonzero(head)
        last = np.append(start[1:], len(to)) - 1
        low, stop = to[start], to[last] + count[last]
        new = ~known[stop]
        low, stop = low[new], stop[new]
        known[stop] = True
    edge = np.flatnonzero(known)
    size = np.diff(edge)
    out = np.empty(n, bool)
    out[order] = np.repeat(size > 1, size) if rank is None else rank[order] > np.repeat(np.minimum.reduceat(rank[order], edge[:-1]), size)
    return out


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    size = 1
    while size * 2 <= width:
        values, size = np.minimum(values[:-size], values[size:]), size * 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


class _Group:
    """Segments of a group's texts, in the order of rows: gram, key, and bytes ``start:stop`` of the group's buffer."""

    def __init__(self, table: pa.Table, text_col: str):
        self.buf, self.offsets = _text.text_buffer(table.column(text_col).combine_chunks() if table.num_rows else pa.array([], pa.string()))
        self.row = np.asarray(table.column(ROW), dtype=np.int64)
        parts = [self._piece(a, b) for a, b in self._pieces()]
        kinds = (np.uint64, np.uint64, np.int64, np.int64)
        self.gram, self.key, self.start, self.stop = (np.concatenate([np.empty(0, k), *[p[i] for p in parts]]) for i, k in enumerate(kinds))
        order = np.lexsort((self.start, self.key, self.gram))
        gram, key = self.gram[order], self.key[order]
        new = np.ones(len(order), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])
        self.kind = np.empty(len(order), np.int64)
        self.kind[order] = np.cumsum(new) - 1
        first = order[new]  # of each kind of segment, in the order of gram and key
        self.kind_gram, self.kind_key, self.kind_start, self.kind_stop = self.gram[first], self.key[first], self.start[first], self.stop[first]
        self.many = np.bincount(self.kind, minlength=len(first)) > 1
        self.first = np.zeros(len(order), bool)
        self.first[first] = True
        doc = np.searchsorted(self.offsets, self.kind_start, "right") - 1
        self.kind_row, self.kind_at = self.row[doc], self.kind_start - self.offsets[doc]

    def _pieces(self):
        """Byte ranges of whole texts, up to PIECE together, or of parts of a longer one that share 399 bytes."""
        o, i = self.offsets, 0
        while i < len(o) - 1:
            j = max(i + 1, int(np.searchsorted(o, o[i] + PIECE, "right")) - 1)
            if o[j] - o[i] <= PIECE:
                yield int(o[i]), int(o[j])
            else:
                for a in range(int(o[i]), int(o[j]) - LENGTH + 1, PIECE):
                    yield a, min(a + PIECE + LENGTH - 1, int(o[j]))
            i = j

    def _piece(self, a: int, b: int):
        buf, width = self.buf[a:b], LENGTH - GRAM + 1
        nothing = np.empty(0, np.int64)
        if len(buf) < LENGTH:
            return nothing.view(np.uint64), nothing.view(np.uint64), nothing, nothing
        values = _text._BYTE_VALUE[buf]
        up, down = _text._BYTE_POWERS.get(len(buf) + 1)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=total[1:])
        gram = _text.mix((total[GRAM:] - total[:-GRAM]) * down[: len(buf) - GRAM + 1])
        low = np.uint64((1 << 24) - 1)
        anchor = (_least((gram & ~low) | np.arange(len(gram), dtype=np.uint64), width) & low).astype(np.int64)
        at = np.arange(len(anchor))
        doc = np.searchsorted(self.offsets, at + a, "right") - 1
        ok = at + a + LENGTH <= self.offsets[doc + 1]
        at, anchor, doc = at[ok], anchor[ok], doc[ok]
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        start, last = at[first], at[np.append(first[1:], len(at)) - 1] if len(first) else at
        stop, anchor = last + LENGTH, anchor[first]
        key = _text.mix(_text.mix((total[stop] - total[start]) * down[start]) + (anchor - start).astype(np.uint64))
        return gram[anchor], key, start + a, stop + a

    def kinds_of(self, table: pa.Table) -> np.ndarray:
        """Numbers of the kinds that a table names by gram and segment."""
        pairs, asked = (np.empty(n, [("gram", np.uint64), ("key", np.uint64)]) for n in (len(self.kind_gram), table.num_rows))
        pairs["gram"], pairs["key"] = self.kind_gram, self.kind_key  # in order
        asked["gram"], asked["key"] = (np.asarray(table.column(c)).astype(np.int64).view(np.uint64) for c in ("gram", "segment"))
        return np.searchsorted(pairs, asked)

    def windows(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of some kinds of segments, and how many each has."""
        count = self.kind_stop[kinds] - self.kind_start[kinds] - LENGTH + 1
        parts = [_text.byte_window_hashes(self.buf[a:b], LENGTH) for a, b in zip(self.kind_start[kinds].tolist(), self.kind_stop[kinds].tolist(), strict=True)]
        return np.concatenate([np.empty(0, np.uint64), *parts]), count


ROW = "__row"
#: What a group is told of a kind of segment: all its windows repeat (ALL: in every place; REST: in all but the first),
#: it is to be sent, it is to be split to windows, and bits of its windows; or of a window.
ALL, REST, SEND, SPLIT, BITS, WINDOW = range(6)
ANSWER = [X.GROUP, "what", "gram", "segment", "bits"]
ASKED = f"gram long not null, segment long not null, {ROW} long not null, place long not null"
SENT = f"{X.GROUP} int, gram long, segment long, times long, bytes binary, {ROW} long, at long"


def _transform(gram: np.ndarray, texts: list[np.ndarray], rank: np.ndarray | None) -> list[bytes]:
    """Bits of the windows of segments, through transforms of about UNIT bytes of segments by gram."""
    if not texts:
        return []
    order = np.argsort(gram, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = gram[order][1:] != gram[order][:-1]
    heads = np.flatnonzero(new)
    mark, bits = np.array([_MARK], np.uint8), [b""] * len(texts)
    held, total = [], 0
    for h, stop in zip(heads.tolist(), [*heads[1:].tolist(), len(order)], strict=True):
        held += order[h:stop].tolist()
        total += sum(len(texts[i]) for i in order[h:stop].tolist())
        if total < UNIT and stop < len(order):
            continue
        size = np.array([len(texts[i]) + 1 for i in held])
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        again = repeated_starts(np.concatenate([x for i in held for x in (texts[i], mark)]), rank=None if rank is None else (np.repeat(rank[held], size) << 32) + at)
        where = 0
        for i in held:
            bits[i] = np.packbits(again[where : where + len(texts[i]) - LENGTH + 1]).tobytes()
            where += len(texts[i]) + 1
        held, total = [], 0
    return bits


def _ranked(table: pa.Table) -> np.ndarray:
    """The place of each row in the order of the texts and of the places in them."""
    out = np.empty(table.num_rows, np.int64)
    out[np.lexsort((np.asarray(table.column("at")), np.asarray(table.column(ROW))))] = np.arange(table.num_rows)
    return out


def _judge(table: pa.Table, keep_first: bool) -> pa.Table:
    """A bucket's segments get bits of the windows to remove; of the single windows of hot grams those to remove stay."""
    table = table.combine_chunks()
    whole = np.asarray(table.column("bytes").is_valid())
    own, single = table.filter(pa.array(whole)), table.filter(pa.array(~whole))
    bits = _transform(np.asarray(own.column("gram")), [np.frombuffer(x.as_buffer(), np.uint8) for x in own.column("bytes")], _ranked(own) if keep_first else None)
    own = own.select([X.GROUP, "gram", "segment"]).append_column("bits", pa.array(bits, pa.binary()))
    kinds, which = np.unique(np.asarray(single.column("gram")), return_inverse=True)
    if keep_first:
        rank, least = _ranked(single), np.full(len(kinds), single.num_rows)
        np.minimum.at(least, which, rank)
        many = rank > least[which]
    else:
        many = np.bincount(which, weights=np.asarray(single.column("times")))[which] > 1 if len(which) else np.empty(0, bool)
    single = single.filter(pa.array(many)).select([X.GROUP, "gram", "segment"])
    single = single.append_column("bits", pa.nulls(single.num_rows, pa.binary()))
    return pa.concat_tables([own.append_column("what", pa.array(np.full(own.num_rows, BITS, np.int32))), single.append_column("what", pa.array(np.full(single.num_rows, WINDOW, np.int32)))]).select(ANSWER)


class _Asked:
    """What a group learned about its kinds of segments: bits of their windows, those to send on, those to split to windows."""

    def __init__(self, g: _Group, back: pa.Table):
        at, what = g.kinds_of(back), np.asarray(back.column("what"))
        self.everywhere, self.rest = np.zeros(len(g.kind_gram), bool), np.zeros(len(g.kind_gram), bool)
        self.everywhere[at[what == ALL]] = True
        self.rest[at[what == REST]] = True
        self.sent, self.split = np.sort(at[what == SEND]), np.sort(at[what == SPLIT])
        self.split = self.split[np.argsort(g.kind_start[self.split])]  # the first of equal windows is the first in the text
        self.window, self.count = g.windows(self.split)
        self.windows, self.head, self.which, self.times = np.unique(self.window, return_index=True, return_inverse=True, return_counts=True)

    def places(self, g: _Group) -> tuple[np.ndarray, np.ndarray]:
        """Row, and place in it, of each distinct window's first start."""
        which = np.repeat(np.arange(len(self.split)), self.count)
        at = np.arange(len(which)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        return g.kind_row[self.split][which][self.head], (g.kind_at[self.split][which] + at)[self.head]


def remove_repeats(docs: DataFrame, text_col: str = "text", groups: int | None = None, give: tuple[str, ...] = ("kept", "kept_text"), keep_first: bool = False, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept_sha256; ``give`` adds the kept bytes, and kept_text without characters cut in two.

    ``keep_first`` leaves one copy of what repeats; without ``keep_text`` the input's text is left out of the result.
    """
    X.ship(docs.sparkSession)
    groups = groups or X.group_count(docs)
    result = [f for f in RESULT.fields if f.name not in ("kept", "kept_text") or f.name in give]
    keep = [c for c in docs.columns if c not in RESULT.names and (keep_text or c != text_col)]
    text = docs.select(*dict.fromkeys([*keep, text_col])).withColumn(ROW, F.monotonically_increasing_id()).withColumn(X.GROUP, X.group_of(F.col(ROW), groups))

    def group(table: pa.Table) -> tuple[pa.Table, _Group]:
        table = table.take(pa.array(np.argsort(np.asarray(table.column(ROW)), kind="stable")))
        return table, _Group(table, text_col)

    def ask(table):
        _, g = group(table)
        return X.released(pa.table({"gram": _long(g.kind_gram), "segment": _long(g.kind_key), ROW: _long(g.kind_row), "place": _long(2 * g.kind_at + g.many)}))

    def send(key, table, back):
        _, g = group(table)
        a = _Asked(g, back)
        n, m = len(a.sent), len(a.windows)
        raw = [g.buf[x:y].tobytes() for x, y in zip(g.kind_start[a.sent].tolist(), g.kind_stop[a.sent].tolist(), strict=True)]
        row, at = a.places(g)
        return pa.table({
            X.GROUP: pa.array(np.full(n + m, key[0].as_py(), np.int32)), "gram": _long(np.concatenate([g.kind_gram[a.sent], a.windows])), "segment": pa.concat_arrays([_long(g.kind_key[a.sent]), pa.nulls(m, pa.int64())]),
            "times": pa.array(np.concatenate([np.ones(n, np.int64), a.times.astype(np.int64)])), "bytes": pa.array(raw + [None] * m, pa.binary()),
            ROW: _long(np.concatenate([g.kind_row[a.sent], row])), "at": _long(np.concatenate([g.kind_at[a.sent], at])),
        })

    def finish(key, table, back):
        table, g = group(table)
        what = np.asarray(back.column("what"))
        a = _Asked(g, back.filter(pa.array(what <= SPLIT)))
        room = g.kind_stop - g.kind_start - LENGTH + 1
        ends = np.cumsum(room)
        bits = np.repeat(a.everywhere, room)  # of the windows of each kind
        mine = back.filter(pa.array(what == BITS))
        for k, yes in zip(g.kinds_of(mine).tolist(), mine.column("bits"), strict=True):
            bits[ends[k] - room[k] : ends[k]] |= np.unpackbits(np.frombuffer(yes.as_buffer(), np.uint8), count=int(room[k])).astype(bool)
        again = X.among(a.windows, np.asarray(back.filter(pa.array(what == WINDOW)).column("gram")).astype(np.int64).view(np.uint64))[a.which]
        if keep_first:  # of equal windows here all but the first go
            later = np.ones(len(a.window), bool)
            later[a.head] = False
            again |= later
        where = 0
        for k, n in zip(a.split.tolist(), a.count.tolist(), strict=True):
            bits[ends[k] - room[k] : ends[k]] |= again[where : where + n]
            where += n
        edge = np.zeros(len(g.buf) + 1, np.int32)
        full = a.rest[g.kind] & ~g.first if len(ends) else g.first
        live = np.flatnonzero((np.add.reduceat(bits, ends - room)[g.kind] > 0) | full) if len(ends) else []
        for s in live:
            k = g.kind[s]
            at = (np.arange(room[k]) if full[s] else np.flatnonzero(bits[ends[k] - room[k] : ends[k]])) + g.start[s]
            edge[at] += 1
            edge[at + LENGTH] -= 1  # starts of one segment differ
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        rows = {f.name: [] for f in RESULT.fields}
        for x, y in zip(g.offsets[:-1].tolist(), g.offsets[1:].tolist(), strict=True):
            off, own = gone[x:y], g.buf[x:y]
            kept = own[~off].tobytes()
            values = y - x, int(off.sum()), int(off[:1].sum() + (off[1:] & ~off[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept if "kept" in give else None, kept.decode("utf-8", "ignore") if "kept_text" in give else None
            for c, v in zip(rows, values, strict=True):
                rows[c].append(v)
        kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}
        return X.released(pa.table({c: table.column(c) for c in keep} | {f.name: pa.array(rows[f.name], kinds[f.dataType]) for f in result}))

    def judge(table):
        return X.released(_judge(table, keep_first))

    c, by_group, of = F.col, text.groupBy(X.GROUP), Window.partitionBy("gram", "segment")
    holder = X.group_of(c(ROW), groups).alias(X.GROUP)
    # a row for each kind of segment and group that holds it, its place doubled, and odd if the group has it twice. Its state is twice the
    # number of its places as far as it tells whether there are several, and odd at the first: all parts read this one column, so they share
    # one exchange, and the groups are asked once
    kinds, place = by_group.applyInArrow(ask, ASKED), F.struct(ROW, "place")
    kinds = kinds.withColumn("state", 2 * (F.count("*").over(of) + F.max(c("place") % 2).over(of)) + (place == F.min(place).over(of)).cast("long"))
    is_first = c("state") % 2 == 1
    twice = kinds.where("state >= 4").select(holder, (F.when(is_first, REST) if keep_first else F.when(F.lit(False), REST)).otherwise(ALL).alias("what"), "gram", "segment")
    first = kinds.where(is_first).select(ROW, "gram", "segment")
    several = first.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
    passed = first.join(several, "gram").select(holder, F.when(c("kinds") > HOT, SPLIT).otherwise(SEND).alias("what"), "gram", "segment")
    sent = by_group.cogroup(passed.groupBy(X.GROUP)).applyInArrow(send, SENT)
    bucket = F.pmod(F.xxhash64("gram"), F.lit(groups)).cast("int")
    judged = sent.groupBy(bucket.alias("__bucket")).applyInArrow(judge, f"{X.GROUP} int, what int, gram long, segment long, bits binary")
    answers = twice.unionByName(passed).withColumn("bits", F.lit(None).cast("binary")).unionByName(judged)
    schema = T.StructType([f for f in text.schema.fields if f.name in keep] + result)
    return by_group.cogroup(answers.groupBy(X.GROUP)).applyInArrow(finish, schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs.select("doc_id", "text"), groups=X.group_count(docs), give=(), keep_text=False)
