"""Cost-balanced packing of token sequences.

Texts become token ids with a closing id. A document longer than a sequence is
cut into full pieces and a rest. The cost of a piece is linear in its length
plus quadratic, for attention within the piece; pieces are taken in descending
order, and each goes to the sequence of lowest cost that still has room. Pieces
are dealt at random into groups of a bounded number, each packed by one task.

* Null texts count as empty and give the closing id alone. Ids play no part in
  the packing: rows with null or equal ids, and repeated rows, are packed each on
  their own. Equal lengths are taken in the order of the input's rows.
* Empty tables give empty results. Input columns other than the id are not
  carried along, so none can clash.
"""

from __future__ import annotations

import heapq
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _exchange as X
from . import _text

SEQUENCE, CLOSING = 2048, 1
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Pieces in one packing group, about, and entries of each of the two generations of a worker's cache of encoded words.
GROUP_PIECES, CACHE = 50_000, 150_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = True

_tokenizers: dict = {}
_encoded: dict = {}


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer.from_file(path)
        _encoded[path] = _text.Generations(CACHE)
    return _tokenizers[path], _encoded[path]


def encode(buf: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and where each text's begin; the same as the tokenizer's over each whole text.

    The vocabulary's patterns never cross white space, nor the edge between an ASCII letter and an ASCII sign
    other than the apostrophe, so each distinct part is encoded once. Parts with "<|" (special tokens) stay whole
    words, and letters are folded only in ASCII parts, where that commutes with the tokenizer's normalisation.
    """
    tokenizer, cache = _tokenizer(path)
    words = _text.words(buf, offsets)
    if not len(words.start):
        return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
    whole = np.zeros(len(words.start), bool)
    if buf.tobytes().find(b"<|") >= 0:
        special = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(np.append((buf[:-1] == 60) & (buf[1:] == 124), False), out=special[1:])
        whole = special[words.end] > special[words.start]
    letter, sign = _LETTER[buf], _MARK[buf]
    cut = np.flatnonzero((letter[1:] & sign[:-1]) | (sign[1:] & letter[:-1])) + 1
    if whole.any():
        cut = cut[~whole[np.maximum(np.searchsorted(words.start, cut, "right") - 1, 0)]]
    first = np.zeros(len(buf), bool)
    first[words.start] = first[cut] = True
    inside = ~_text._SPACE[buf]
    compact, edge = buf[inside], np.append(np.flatnonzero(first[inside]), int(inside.sum()))
    fold = ~np.logical_or.reduceat(compact >= 128, edge[:-1])
    if whole.any():
        fold &= ~whole[np.searchsorted(words.start, np.flatnonzero(first), "right") - 1]
    folded = np.repeat(fold, np.diff(edge))
    compact = np.where(folded, _text._LOWER[compact], compact)
    parts = pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(compact)]).dictionary_encode()
    distinct = parts.dictionary.to_pylist()
    missing = cache.missing(distinct)
    for i in range(0, len(missing), 20_000):
        some = missing[i : i + 20_000]
        for w, e in zip(some, tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
            cache.young[w] = array("I", e.ids).tobytes()
    taken = pa.array([cache.young[w] for w in distinct], pa.large_binary()).take(parts.indices)
    cache.trim()
    upto = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, taken.offset * 8) // 4
    out = np.frombuffer(taken.buffers()[2] or b"", np.uint32, int(upto[-1]))  # the parts' ids, one after the other
    of_text = np.searchsorted(np.flatnonzero(first), offsets)
    return out, upto[of_text]


def cut(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, keep: bool = True) -> DataFrame:
    """A row for each piece: (uid, id, start, length, ids_crc32, doc_tokens), with the ids' bytes if asked for.

    Unless ``keep``, encoded words go with their task, and fewer are held, where memory is short.
    """

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        cache = _tokenizer(path)[1]
        cache.most = CACHE if keep else CACHE // 2
        for batch in _text.slices(batches, "__text", 2 << 20 if keep else 1 << 20):
            buf, offsets = _text.text_buffer(batch.column(1))
            ids, first = encode(buf, offsets, path)
            rows = [[], [], [], [], []]
            raw = []
            for d in range(batch.num_rows):
                own = np.append(ids[first[d] : first[d + 1]], np.uint32(CLOSING)).astype("<u4")
                for s in range(0, len(own), SEQUENCE):
                    piece = own[s : s + SEQUENCE].tobytes()
                    for c, v in zip(rows, (d, s, len(piece) // 4, zlib.crc32(piece), len(own)), strict=True):
                        c.append(v)
                    raw.append(piece if with_ids else None)
            n = len(raw)
            columns = [pa.array(np.arange(at, at + n)), batch.column(0).take(pa.array(rows[0], pa.int64())), *[pa.array(c, pa.int64()) for c in rows[1:]], pa.array(raw, pa.binary())]
            at += n
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        X.keep("packing", cache.clear)
        X.release("packing" if keep else "")

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    longs = [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]
    schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField(id_col, rows.schema["__id"].dataType), *longs, T.StructField("ids", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def assign(length: np.ndarray, room: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece: descending, to the lowest-cost sequence with room, else a new one.

    Sequences start out as many as the tokens fill. A tree over the room left holds the lowest cost at each room,
    so a piece is placed in the time of its height.
    """
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    opened = max(1, -(-int(length.sum()) // room))
    cost = [0.0] * opened
    left = [room] * opened
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(room + 1)]
    heaps[room] = [(0.0, k) for k in range(opened)]
    width = 1 << room.bit_length()
    far = (float("inf"), -1)
    tree = [far] * (2 * width)

    def update(r: int) -> None:
        tree[i := width + r] = heaps[r][0] if heaps[r] else far
        while i > 1:
            i //= 2
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

    update(room)
    for p in np.argsort(-length, kind="stable").tolist():
        n = int(length[p])
        best, i, j = far, width + n, width + room + 1  # the lowest cost among rooms n..room
        while i < j:
            if i & 1:
                best, i = min(best, tree[i]), i + 1
            if j & 1:
                j -= 1
                best = min(best, tree[j])
            i, j = i // 2, j // 2
        k = best[1]
        if k < 0:
            k = len(left)
            left.append(room)
            cost.append(0.0)
        else:
            heapq.heappop(heaps[left[k]])
            update(left[k])
        sequence[p], offset[p] = k, room - left[k]
        left[k] -= n
        cost[k] += LINEAR * n + QUADRATIC * n * n
        heapq.heappush(heaps[left[k]], (cost[k], k))
        update(left[k])
    return sequence, offset


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = GROUP_PIECES, with_ids: bool = False, keep: bool = True) -> DataFrame:
    """The pieces of all documents with their sequence_id and offset. ``path`` is the tokenizer's file."""
    X.ship(docs.sparkSession)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    pieces = X.written(cut(docs, path, id_col, text_col, with_ids, keep), "pieces")  # the uids must not change any more
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn(X.GROUP, F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int"))

    def place(key, table):
        order = np.argsort(np.asarray(table.column("uid")))
        table = table.take(pa.array(order))
        length = np.asarray(table.column("length"))
        full = length == SEQUENCE
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        sequence[~full], offset[~full] = assign(length[~full])
        rest = int(sequence[~full].max()) + 1 if (~full).any() else 0
        sequence[full] = rest + np.arange(int(full.sum()))
        out = {c: table.column(c) for c in names}
        return pa.table(out | {"sequence_id": pa.array(sequence + (key[0].as_py() << 32)), "offset": pa.array(offset)})

    names = [c for c in pieces.columns if c != "uid" and (with_ids or c != "ids")]
    schema = T.StructType([pieces.schema[c] for c in names] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.groupBy(X.GROUP).applyInArrow(place, schema)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
