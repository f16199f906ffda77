"""op2 against the tiktoken library, and back."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import types as T

from duplexa.llm import byte_bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.ranks(PATH), special_tokens={})


def want(reference, text):
    ids = reference.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


SPACES = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "　", "​", "᠎", " \n ", "\n\n", "   x"]


def texts():
    r = random.Random(8)
    parts = ["a", "the", "Hello", "don't", "I'M", "'s", "'", "''ll", "é", "ß", "漢字", "テ", "123", "4.5", "½", "!!", "...", "—", "👍🏽", "<|endoftext|>", "__", "́", "ﬁ", "АБ", "#$%", "\0", *SPACES, *SPACES]
    out = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(1500)]
    return out + [None, "", " ", "  ", "a ", "a  ", "\n", " a", "  a", "a" * 700, "ab" * 400, " " * 300 + "x", "=" * 600, "漢" * 300, "".join(r.choice("abcxyz") for _ in range(2000))]


def test_equals_tiktoken(spark, reference):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType())])
    rows = list(enumerate(texts())) + [(None, "x y"), (0, "again")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], schema)
    out = B.decode_ids(B.encode_texts(df, PATH), PATH).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want(reference, r["text"]), r["text"]
        assert np.frombuffer(r["ids"], "<u4").tolist() == reference.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert B.encode_texts(df.limit(0), PATH).count() == 0


def test_long_words_by_either_query(reference, monkeypatch):
    """Contracting all least pairs of a word in a round gives what contracting the leftmost alone gives, and what the library gives."""
    coder = B.Codec(PATH)
    r = random.Random(3)
    words = [bytes(r.choice(b"abcde \n=") for _ in range(r.randrange(1, 100))) for _ in range(60)] + [b"a" * 90, b"aab" * 30, "漢字".encode() * 15]
    one = [x.tolist() for x in coder.encode(words)]
    monkeypatch.setattr(B, "LONG", 0)
    assert [x.tolist() for x in coder.encode(words)] == one
    long = [("ACGT"[r.randrange(4)] for _ in range(6000)), "x" * 5000, "そして" * 900, (r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4000))]
    for w in map("".join, long):
        assert np.concatenate([coder.encode([p.encode()])[0] for p in coder.pattern.findall(w)]).tolist() == reference.encode_ordinary(w)


def test_cache_is_bounded():
    g = B.Generations(10)
    for i in range(100):
        for k in g.missing([i]):
            g.young[k] = k
        g.trim()
        assert len(g.young) + len(g.old) <= 22


def test_query(spark, reference):
    d = "/root/testdata/sf0.001"
    have = {r[0]: r[1] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    rows = B.op2_byte_bpe(spark, d).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows} == {i: want(reference, t) for i, t in have.items()}
