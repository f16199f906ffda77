"""Byte-level BPE by recursive queries of DuckDB, one in-memory database a worker.

Texts are cut into words by the pattern; each distinct word of a slice that the
worker has not met is encoded by one recursive query. Its rows are (word,
position, token): every round joins neighbouring tokens with the merge table and
contracts each word's leftmost pair of least rank, until no word has a pair. A
second query decodes: tokens join the vocabulary, and an ordered aggregation
puts each word's bytes together again. Documents are the words in order, so equal
words are encoded and decoded once for a slice, not once for each time they occur.

The pattern, too, is applied to distinct pieces: an ASCII white space run is
cut where the pattern cuts it whatever stands around. Texts with other white space
are matched whole. For words of more than ``LONG`` bytes a round contracts not the leftmost pair of
least rank alone but the word's others too, from the left, up to one that makes a pair of lower rank: the same
contractions in the same order, in fewer rounds.

* Null texts count as empty: no tokens. Ids of documents play no part: null,
  equal or repeated rows are encoded alike. Empty tables give empty results.
* Input columns are kept unless a result column has their name.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import _exchange as X
from . import _text
from ._text import Generations

LONG = 128
#: Words (and pieces) of each of the two generations of a worker's cache.
CACHE = 300_000

RESULT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("ids", T.BinaryType())])

ENCODE = """
WITH RECURSIVE tokens(round, w, p, t) AS (
    SELECT 0, w, p, t FROM start
    UNION ALL
    (
        WITH pair AS (
            SELECT round, w, p, t, lead(t) OVER o AS n, lead(p) OVER o AS q FROM tokens WINDOW o AS (PARTITION BY w ORDER BY p)
        ), least AS (
            SELECT w, min(m::BIGINT * 4294967296 + p) AS k, arg_min(q, m::BIGINT * 4294967296 + p) AS q
            FROM pair JOIN merges ON l = t AND r = n GROUP BY w
        )
        SELECT round + 1, pair.w, pair.p, CASE WHEN pair.p = least.k % 4294967296 THEN (least.k // 4294967296)::INTEGER ELSE pair.t END
        FROM pair JOIN least ON pair.w = least.w
        WHERE pair.p <> least.q
    )
)
SELECT w, p, t FROM tokens QUALIFY round = max(round) OVER (PARTITION BY w) ORDER BY w, p
"""

ENCODE_LONG = """
WITH RECURSIVE tokens(round, w, p, t) AS (
    SELECT 0, w, p, t FROM start
    UNION ALL
    (
        WITH pair AS (
            SELECT round, w, p, t, lead(t) OVER o AS n, lead(p) OVER o AS q, lag(t) OVER o AS before, lead(t, 2) OVER o AS after, row_number() OVER o AS i FROM tokens WINDOW o AS (PARTITION BY w ORDER BY p)
        ), known AS (
            SELECT w, p, q, i, m, before, after FROM pair JOIN merges ON l = t AND r = n
        ), least AS (
            SELECT w, min(m) AS k FROM known GROUP BY w
        ), mine AS (
            SELECT known.w, p, q, m, i, before, after, i - row_number() OVER (PARTITION BY known.w ORDER BY i) AS island FROM known JOIN least ON known.w = least.w AND m = k
        ), apart AS (
            SELECT * FROM mine QUALIFY row_number() OVER (PARTITION BY w, island ORDER BY i) % 2 = 1
        ), beside AS (
            SELECT w, p, q, m, i, after, CASE WHEN lag(i) OVER (PARTITION BY w ORDER BY i) = i - 2 THEN m ELSE before END AS before FROM apart
        ), lower AS (
            SELECT w, p, q, beside.m, i, coalesce(a.m < beside.m, false) OR coalesce(b.m < beside.m, false) AS lower
            FROM beside LEFT JOIN merges a ON a.l = before AND a.r = beside.m LEFT JOIN merges b ON b.l = beside.m AND b.r = after
        ), taken AS (
            SELECT w, p, q, m FROM lower QUALIFY coalesce(sum(lower::INTEGER) OVER (PARTITION BY w ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0
        )
        SELECT round + 1, pair.w, pair.p, coalesce(taken.m, pair.t)
        FROM pair JOIN least ON pair.w = least.w LEFT JOIN taken ON taken.w = pair.w AND taken.p = pair.p
        ANTI JOIN taken gone ON gone.w = pair.w AND gone.q = pair.p
    )
)
SELECT w, p, t FROM tokens QUALIFY round = max(round) OVER (PARTITION BY w) ORDER BY w, p
"""

DECODE = """
SELECT w, unhex(string_agg(piece, '' ORDER BY p)) AS bytes FROM coded JOIN vocabulary ON t = id GROUP BY w ORDER BY w
"""


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Merge table and vocabulary of a rank file in a database of its own."""

    def __init__(self, path: str):
        import duckdb
        import regex
        from public_tokenizers import PATTERN

        self.ranks = ranks(path)
        self.pattern = regex.compile(PATTERN)
        rows = [(self.ranks[w[:i]], self.ranks[w[i:]], k) for w, k in self.ranks.items() for i in range(1, len(w)) if w[:i] in self.ranks and w[i:] in self.ranks]
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        left, right, merged = (pa.array(c, pa.int32()) for c in zip(*rows, strict=True))
        self._table("merges", l=left, r=right, m=merged)
        self._table("vocabulary", id=pa.array(list(self.ranks.values()), pa.int32()), piece=pa.array([w.hex() for w in self.ranks], pa.string()))
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.words, self.pieces = Generations(CACHE), Generations(CACHE)

    def _table(self, name: str, **columns) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _query(self, name: str, table: pa.Table, sql: str) -> pa.Table:
        self.db.register(name, table)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        out = [np.empty(0, np.int32)] * len(words)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= LONG]
        for some, query in [(short, ENCODE)] + [([i], ENCODE_LONG) for i, w in enumerate(words) if len(w) > LONG]:
            if not some:
                continue
            size = np.array([len(words[i]) for i in some])
            of = np.repeat(np.arange(len(some), dtype=np.int32), size)
            at = (np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
            codes = self.byte[np.frombuffer(b"".join(words[i] for i in some), np.uint8)]
            got = self._query("start", pa.table({"w": of, "p": at, "t": codes}), query)
            ids = np.asarray(got.column("t"), dtype=np.int32)
            edge = np.searchsorted(np.asarray(got.column("w")), np.arange(len(some) + 1))
            for k, i in enumerate(some):
                out[i] = ids[edge[k] : edge[k + 1]]
        return out

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """Bytes of each list of ids; unknown ids raise."""
        size = np.array([len(x) for x in ids], np.int64)
        if not size.sum():
            return [b""] * len(ids)
        of = np.repeat(np.arange(len(ids), dtype=np.int32), size)
        at = (np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        flat = np.concatenate(ids).astype(np.int32)
        if flat.min() < 0 or flat.max() >= len(self.ranks):
            raise ValueError("an id outside the vocabulary")
        got = self._query("coded", pa.table({"w": of, "p": at, "t": flat}), DECODE)
        out = [b""] * len(ids)
        for w, b in zip(got.column("w").to_pylist(), got.column("bytes").to_pylist(), strict=True):
            out[w] = b
        return out

    def _cached(self, words: list[bytes]) -> dict:
        """word -> (count, decimal ids with a space before each, little-endian ids, decoded bytes), whether just encoded or met before."""
        cache = self.words
        new = cache.missing(words)
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            ids = self.encode(some)
            for w, x, b in zip(some, ids, self.decode(ids), strict=True):
                cache.young[w] = (len(x), "".join([f" {t}" for t in x.tolist()]).encode(), x.astype("<u4").tobytes(), b)
        return cache.young

    def pieces_of(self, distinct: list[bytes]) -> list[tuple]:
        """Entries of pieces of text, each cut by the pattern on its own."""
        new = self.pieces.missing(distinct)
        if new:
            cut = [[w.encode() for w in self.pattern.findall(p.decode())] for p in new]
            known = self._cached(list({w for c in cut for w in c}))
            for p, c in zip(new, cut, strict=True):
                parts = [known[w] for w in c]
                self.pieces.young[p] = parts[0] if len(parts) == 1 else (sum(x[0] for x in parts), b"".join(x[1] for x in parts), b"".join(x[2] for x in parts), b"".join(x[3] for x in parts))
            self.words.trim()
        out = [self.pieces.young[p] for p in distinct]
        self.pieces.trim()
        return out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


_CONTROL = np.zeros(256, bool)
_CONTROL[0x1C:0x20] = True


def _odd(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts with white space beyond 0x20 and 0x09-0x0D (or bytes that look like it): these are matched whole."""
    flag = _CONTROL[buf]
    if len(buf) > 2:
        a, b, c = buf[:-2], buf[1:-1], buf[2:]
        flag[:-2] |= ((a == 0xE1) & ((b == 0x9A) | (b == 0xA0))) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81)) & (c >= 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        flag[:-1] |= (buf[:-1] == 0xC2) & ((buf[1:] == 0x85) | (buf[1:] == 0xA0))
    total = np.concatenate([[0], np.cumsum(flag)])
    return np.diff(total[offsets]) > 0


def cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of pieces that the pattern never crosses, for texts whose white space is all ASCII.

    A white space run is cut off before it; before its last byte, unless it ends the text; and after that byte
    unless it is a space, which goes with the word.
    """
    space = _text._SPACE[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offsets[:-1]] = True
    final = np.zeros(len(buf) + 1, bool)
    final[offsets[1:]] = True
    head = space.copy()
    head[1:] &= ~space[:-1] | first[1:-1]
    first[:-1] |= head
    last = space & (np.append(~space[1:], True) | final[1:])
    last &= ~final[1:]
    first[:-1] |= last
    first[1:] |= last & (buf != 0x20)
    return np.flatnonzero(first[:-1])


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids (little-endian unsigned 32 bit), and the digests of ids and decoded bytes."""

    def make():
        coder = codec(path)

        def encode(column: pa.Array) -> list:
            buf, offsets = _text.text_buffer(column)
            odd = _odd(buf, offsets)
            start = cuts(buf, offsets) if len(buf) else np.empty(0, np.int64)
            doc = np.searchsorted(offsets, start, "right") - 1
            plain = ~odd[doc]
            edge = np.append(start, len(buf)).astype(np.int32)
            pieces = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(buf))]).filter(pa.array(plain)).dictionary_encode()
            table = coder.pieces_of(pieces.dictionary.to_pylist())
            where = np.searchsorted(doc[plain], np.arange(len(column) + 1))
            tokens = np.cumsum(np.append(0, np.array([x[0] for x in table], np.int64)[np.asarray(pieces.indices, dtype=np.int64)]))[where]
            # what stands one after the other in a text does so in the buffers of the pieces taken in order
            taken = [pa.array([x[k] for x in table], pa.large_binary()).take(pieces.indices) for k in ((1, 3, 2) if with_ids else (1, 3))]
            data = [memoryview(x.buffers()[2] or b"") for x in taken]
            edges = [np.frombuffer(x.buffers()[1], np.int64, len(x) + 1, x.offset * 8)[where].tolist() if len(x) else [0] * len(where) for x in taken]
            out = [[], [], [], []]
            for d in range(len(column)):
                if odd[d]:
                    words = [w.encode() for w in coder.pattern.findall(buf[offsets[d] : offsets[d + 1]].tobytes().decode())]
                    known = coder._cached(list(set(words)))
                    own = [known[w] for w in words]
                    coder.words.trim()
                    n, parts = sum(x[0] for x in own), [b"".join([x[k] for x in own]) for k in (1, 3, 2)]
                else:
                    n, parts = int(tokens[d + 1] - tokens[d]), [x[e[d] : e[d + 1]] for x, e in zip(data, edges, strict=True)]
                for c, v in zip(out, (n, hashlib.sha256(parts[0][1:]).hexdigest(), hashlib.sha256(parts[1]).hexdigest(), bytes(parts[2]) if with_ids else None), strict=True):
                    c.append(v)
            return out

        return encode

    return X.by_text(docs, text_col, RESULT, make)


def decode_ids(frame: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``frame`` with the bytes of a column of little-endian ids (null: null)."""
    X.ship(frame.sparkSession)
    at = frame.columns.index(ids_col)
    keep = [c for c in frame.columns if c != out_col]

    def run(batches):
        coder = codec(path)
        for batch in batches:
            raw = batch.column(at).to_pylist()
            got = coder.decode([np.frombuffer(x or b"", "<u4").astype(np.int64) for x in raw])
            new = pa.array([None if x is None else b for x, b in zip(raw, got, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [new], names=[*keep, out_col])

    return frame.mapInArrow(run, T.StructType([f for f in frame.schema.fields if f.name in keep] + [T.StructField(out_col, T.BinaryType())]))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
