"""op7: ids against the tokenizer over whole texts, exact cover, balance and padding."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import types as T

from duplexa.llm import _text
from duplexa.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def mine(texts):
    ids, first = P.encode(*_text.text_buffer(pa.array(texts, pa.string())), PATH)
    return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]


TEXTS = [
    None, "", " ", "Hello, World! don't I'M we'LL x's", "a<|startoftext|>b <|ENDOFTEXT|> <|endoftext|>.", "J̌ ǰ Å", "≠ a≠b .́", "x y z\x85w\x1cv",
    "ΟΔΟΣ Σ ΑΣ.", "12ab34,,,!!!''''", "日本語、テスト。ok", "İstanbul ﬁ ½²", "éÉ 'S 'ſ", "a" * 5000, "́start", "<|", "<| a.b |>C.D", "İ.I", "#*$%&|<> end...", "👍🏽x👍", "tab\x0bvt\x0cff",
]


def test_ids_equal_whole_texts():
    assert mine(TEXTS) == whole(TEXTS)
    r = random.Random(4)
    alphabet = ["a", "B", "'", "s", "é", "é", ".", ",", "<|", "|>", "<|endoftext|>", " ", "\n", " ", "1", "ß", "Σ", "̸", "=", "J̌", "漢", "-"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(3000)]
    assert mine(texts) == whole(texts)


def test_assignment_takes_the_cheapest_with_room():
    r = np.random.default_rng(1)
    length = r.integers(1, 40, 300)
    sequence, offset = P.assign(length, 64)
    left, cost = [64] * max(1, -(-int(length.sum()) // 64)), {}
    want = {}
    for p in np.argsort(-length, kind="stable"):
        n = int(length[p])
        fits = [(cost.get(k, 0.0), k) for k in range(len(left)) if left[k] >= n]
        k = min(fits)[1] if fits else len(left)
        if not fits:
            left.append(64)
        want[p] = (k, 64 - left[k])
        left[k] -= n
        cost[k] = cost.get(k, 0.0) + P.LINEAR * n + P.QUADRATIC * n * n
    assert {p: (int(sequence[p]), int(offset[p])) for p in range(300)} == want


def check(rows, texts):
    ids = {i: [*x, 1] for (i, _), x in zip(texts, whole([t for _, t in texts]))}
    seen, used = {}, {}
    for r in rows:
        own = np.array(ids[r["doc_id"]], "<u4")
        part = own[r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] > 0 and r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(part.tobytes())
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert seen.keys() == ids.keys()
    for i, parts in seen.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == len(ids[i])
    for parts in used.values():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at <= 2048
    return sum(len(x) for x in ids.values()) / (2048 * len(used))


def test_query_and_edges(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("length", T.StringType())])
    texts = list(enumerate(TEXTS)) + [(100, "word " * 9000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], schema)
    check(P.pack(df, group_pieces=5).collect(), texts)
    assert P.pack(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "a b", None)] * 3, schema)
    assert [r["doc_tokens"] for r in P.pack(twice, with_ids=True).collect()] == [3] * 3
    d = "/root/testdata/sf0.01"
    texts = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    share = check(P.op7_packing(spark, d).collect(), texts)
    print("filled", share)
    assert share > 0.97


def test_encoded_words_outlive_a_slice_and_a_task(monkeypatch):
    """A full cache loses its older half only, and the words of the slice at hand never; another operator's task ends it."""
    from duplexa.llm import _exchange as X

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setitem(P._encoded, path, _text.Generations(4))
    P._tokenizer(path)
    monkeypatch.setitem(P._encoded, path, _text.Generations(4))
    tokenizer = P._tokenizer(path)[0]
    asked = []
    real = tokenizer.encode_batch_fast

    class Counting:
        def encode_batch_fast(self, words, **more):
            asked.extend(words)
            return real(words, **more)

    monkeypatch.setitem(P._tokenizers, path, Counting())
    for text in ("one two three", "four five six", "one two three", "one seven"):
        raw = text.encode()
        ids, first = P.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), path)
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids and first.tolist() == [0, len(ids)]
    assert asked == ["one", "two", "three", "four", "five", "six", "seven"]
    X.keep("packing", P._encoded[path].clear)
    X.release("packing")
    assert P._encoded[path].young
    X.release()
    assert not P._encoded[path].young and not P._encoded[path].old
