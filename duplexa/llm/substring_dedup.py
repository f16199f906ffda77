"""Substring dedup by difference-cover anchors.

A word is removed if some window of 50 consecutive words that covers it also
starts in a document with a smaller id. Windows of 20 words are hashed only at
word positions whose remainder modulo 31 lies in a perfect difference cover of
six remainders. Whatever the distance between two equal windows of 50 words,
one of the 31 shifts puts an anchor on cover positions of both, so equal long
windows always share an aligned anchor. Only anchors that occur in two
documents go on; each is extended to the windows that contain it, and a window
counts by the smallest document that has it.

* Rows with null text have no words. Rows with a null id take no part in the
  comparison and keep all words. Rows with equal ids count as one document's:
  none of them removes words from another.
* Texts under 50 words lose nothing. Ties cannot occur: only a strictly smaller
  id removes. Empty tables give empty results.
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

WINDOW, ANCHOR, PERIOD = 50, 20, 31
#: A perfect difference cover of 31: every remainder is a difference of two of these.
COVER = np.array([1, 5, 11, 24, 25, 27])

RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())])


class _Group:
    """The documents of a group: their words, anchors and candidate windows."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str):
        table = table.combine_chunks()
        batch = table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)
        column = batch.column(batch.schema.get_field_index(id_col))
        self.ids = np.asarray(column.fill_null(0)).astype(np.int64)
        known = ~np.asarray(column.is_null())
        self.words = _text.words(*_text.text_buffer(batch.column(batch.schema.get_field_index(text_col))))
        self.hash = self.words.hashes()
        first = self.words.first
        self.count = np.diff(first)
        self.doc = self.words.doc_of()
        at = np.arange(len(self.hash)) - first[self.doc]
        room = self.count[self.doc]
        use = (room >= WINDOW) & known[self.doc]
        self.start = np.flatnonzero(use & (at + WINDOW <= room))  # of windows
        self.at = np.flatnonzero(use & (at + ANCHOR <= room) & np.isin(at % PERIOD, COVER))  # of anchors
        self.anchor = _text.window_hashes(self.hash, ANCHOR)[self.at]
        self.anchors, self.which = np.unique(self.anchor, return_inverse=True)

    def anchors_in_two_documents(self) -> np.ndarray:
        ids = self.ids[self.doc[self.at]]
        low = np.full(len(self.anchors), np.iinfo(np.int64).max)
        high = np.full(len(self.anchors), np.iinfo(np.int64).min)
        np.minimum.at(low, self.which, ids)
        np.maximum.at(high, self.which, ids)
        return low < high

    def candidates(self, shared: np.ndarray) -> None:
        """Windows that contain a shared anchor, and each distinct one's smallest document in this group."""
        n = len(self.hash)
        near = np.zeros(n + 1, np.int64)
        at = self.at[shared[self.which]]
        np.add.at(near, np.maximum(at - (WINDOW - ANCHOR), self.words.first[self.doc[at]]), 1)
        np.add.at(near, at + 1, -1)
        self.start = self.start[np.cumsum(near[:-1])[self.start] > 0]
        key = _text.window_hashes(self.hash, WINDOW)[self.start] if len(self.start) else np.empty(0, np.uint64)
        check = _text.window_hashes(_text.mix(self.hash), WINDOW)[self.start] if len(self.start) else key
        both = np.empty(len(key), [("key", np.uint64), ("check", np.uint32)])
        both["key"], both["check"] = key, check >> np.uint64(32)
        order = np.lexsort((both["check"], both["key"]))
        both = both[order]
        new = np.ones(len(both), bool)
        new[1:] = both[1:] != both[:-1]
        self.window = np.empty(len(both), np.int64)
        self.window[order] = np.cumsum(new) - 1
        self.windows = both[new]
        self.low = np.full(len(self.windows), np.iinfo(np.int64).max)
        np.minimum.at(self.low, self.window, self.ids[self.doc[self.start]])

    def covered(self, elsewhere: np.ndarray) -> np.ndarray:
        """Words to remove: under a window that a smaller document of this or another group has."""
        ids = self.ids[self.doc[self.start]]
        start = self.start[elsewhere[self.window] | (self.low[self.window] < ids)]
        edge = np.zeros(len(self.hash) + 1, np.int64)
        edge[start] += 1
        np.add.at(edge, start + WINDOW, -1)
        return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: int | None = None, give: tuple[str, ...] = ("kept_text",), keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_sha256; ``give`` adds kept_text (kept words joined by one space).

    Without ``keep_text`` the input's text is left out of the result.
    """
    X.ship(docs.sparkSession)
    groups = groups or X.group_count(docs)
    result = [f for f in RESULT.fields if f.name != "kept_text" or f.name in give]
    keep = [c for c in docs.columns if c not in RESULT.names and (keep_text or c != text_col)]
    text = X.in_groups(docs.select(*dict.fromkeys([*keep, id_col, text_col])), groups)

    def ask(key, table):
        g = _Group(table, id_col, text_col)
        return pa.table({"anchor": _long(g.anchors), X.GROUP: pa.array(np.full(len(g.anchors), key[0].as_py(), np.int32)), "many": pa.array(g.anchors_in_two_documents())})

    def extend(key, table, back):
        g = _Group(table, id_col, text_col)
        g.candidates(X.among(g.anchors, _keys(back, "anchor")))
        return pa.table({"key": _long(g.windows["key"]), "check": pa.array(g.windows["check"].astype(np.int64)), X.GROUP: pa.array(np.full(len(g.low), key[0].as_py(), np.int32)), "low": pa.array(g.low)})

    def finish(key, table, back):
        g = _Group(table, id_col, text_col)
        window = np.asarray(back.column("check").is_valid())
        anchors, removed = back.filter(pa.array(~window)), back.filter(pa.array(window))
        g.candidates(X.among(g.anchors, _keys(anchors, "key")))
        told = np.empty(removed.num_rows, g.windows.dtype)
        told["key"], told["check"] = _keys(removed, "key"), _keys(removed, "check")
        smaller = np.zeros(len(g.windows), bool)
        smaller[np.searchsorted(g.windows, told)] = True
        gone = g.covered(smaller)
        raw, lost, kept = g.words.buf.tobytes(), np.zeros(len(g.ids), np.int64), []
        for i, (a, b) in enumerate(zip(g.words.first[:-1], g.words.first[1:], strict=True)):
            stay = np.flatnonzero(~gone[a:b]) + a
            lost[i] = (b - a) - len(stay)
            kept.append(b" ".join([raw[s:e] for s, e in zip(g.words.start[stay].tolist(), g.words.end[stay].tolist(), strict=True)]))
        out = {c: table.column(c) for c in keep}
        out |= {"n_words": pa.array(g.count.astype(np.int64)), "n_removed": pa.array(lost), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept])}
        if "kept_text" in give:
            out["kept_text"] = pa.array([x.decode() for x in kept], pa.string())
        return X.released(pa.table(out))

    by_group, none = text.groupBy(X.GROUP), F.lit(None).cast("long")
    asked = by_group.applyInArrow(ask, f"anchor long, {X.GROUP} int, many boolean")
    of = Window.partitionBy("anchor")
    shared = asked.withColumn("shared", (F.count("*").over(of) > 1) | F.max("many").over(of)).where("shared").select(X.GROUP, "anchor")
    windows = by_group.cogroup(shared.groupBy(X.GROUP)).applyInArrow(extend, f"key long, check long, {X.GROUP} int, low long")
    least = F.min("low").over(Window.partitionBy("key", "check"))
    removed = windows.withColumn("least", least).where("least < low").select(X.GROUP, "key", "check")
    answers = shared.select(X.GROUP, F.col("anchor").alias("key"), none.alias("check")).unionByName(removed)
    schema = T.StructType([f for f in text.schema.fields if f.name in keep] + result)
    return by_group.cogroup(answers.groupBy(X.GROUP)).applyInArrow(finish, schema)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _keys(table: pa.Table, column: str) -> np.ndarray:
    return np.asarray(table.column(column)).astype(np.int64).view(np.uint64)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs.select("doc_id", "text"), groups=X.group_count(docs), give=(), keep_text=False)
