"""The pipeline's stages against plain Python on what each received."""

import corpus_pipeline as C
import numpy as np
from test_ngram_join import brute as groups
from test_packing import check
from test_secret_scan import brute as secrets


def first_copies(rows):
    """What is left of each (id, text) when a byte goes if a 400-byte string over it starts earlier as well."""
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 399):
            if b[s : s + 400] in seen:
                gone[s : s + 400] = True
            seen.add(b[s : s + 400])
        out[i] = np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
    return out


def test_stages(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}
    seen, order = [rows(docs)], []
    for name, stage in C.STAGES[:-1]:
        stage(spark, docs, d).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == C.COLUMNS
        seen.append(rows(docs))
    raw, good, alone, cut, clean = seen
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert good and all(len(r["text"].split()) >= 10 for r in good.values())
    lost = [i for i in raw if i not in good and labels.get(i) == 1 and len(raw[i]["text"].split()) >= 10]
    assert len(lost) <= 0.05 * len(raw)
    low = {i: c for i, _, c in groups([(i, r["text"]) for i, r in good.items()])}
    assert set(alone) == {i for i in good if low[i] == i}
    stored = spark.read.parquet(str(tmp_path / "ngram_join")).withColumn("at", C.F.monotonically_increasing_id()).orderBy("at").collect()
    assert {i: r["text"] for i, r in cut.items()} == first_copies([(r["doc_id"], r["text"]) for r in stored])
    assert all(r["n_chars"] == len(r["text"]) for r in cut.values())
    for i, r in clean.items():
        found = sum(secrets(cut[i]["text"])[:3])
        assert ("<secret>" in r["text"]) or found == 0
        assert sum(secrets(r["text"])[:3]) == 0
    assert check(C.pack(spark, docs, d).collect(), [(i, r["text"]) for i, r in clean.items()]) > 0.9
    # the whole run packs the same texts; where a copy stays may follow the order in which rows are stored
    whole = C.run(spark, d).collect()
    kept = {r["doc_id"]: r["doc_tokens"] for r in whole}
    assert set(kept) == set(clean)
    assert check(whole, [(i, r["text"]) for i, r in clean.items()]) > 0.9


def test_empty(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == C.COLUMNS and docs.count() == 0
    assert C.pack(spark, docs, d).count() == 0


def table(spark, path, rows):
    spark.createDataFrame([(i, t, "en", "x", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_repeated_rows(spark, tmp_path):
    """One row of each group stays with its text, whatever the ids."""
    text = lambda k: " ".join(f"{k}word{i}" for i in range(120))
    once = {k: text(k) for k in "abcdef"}
    rows = [(1, once["a"]), (1, once["a"]), (2, once["b"]), (3, once["b"]), (3, once["c"]), (None, once["d"]), (None, once["d"]), (None, once["e"]), (5, once["e"]), (6, once["f"]), (6, once["f"] + " more"), (None, once["f"])]
    C.near_duplicates(spark, table(spark, tmp_path / "0", rows), "").write.parquet(str(tmp_path / "1"))
    alone = spark.read.parquet(str(tmp_path / "1"))
    got = sorted(((r["doc_id"], r["text"].split("w")[0]) for r in alone.collect()), key=str)
    assert got == sorted([(1, "a"), (2, "b"), (3, "c"), (None, "d"), (5, "e"), (6, "f")], key=str)
    after = C.repeats(spark, alone, "").collect()
    assert sorted(r["text"].split("w")[0] for r in after) == list("abcdef") and all(len(r["text"]) > 900 for r in after)


def test_one_copy_of_a_passage_stays(spark, tmp_path):
    """A passage of three documents is left in the first; so is a text whose rows repeat."""
    own = lambda k: " ".join(f"{k}{i}" for i in range(60))
    passage = " ".join(f"shared{i}" for i in range(70))
    rows = [(4, f"{own('a')} {passage}"), (2, f"{own('b')} {passage} {own('c')}"), (9, passage + " " + own("d")), (7, own("e") * 3), (7, own("e") * 3)]
    out = [r["text"] for r in C.repeats(spark, table(spark, tmp_path / "t", rows), "").collect()]
    assert sum(passage in t for t in out) == 1 and sum(own("e") in t for t in out) == 1 and len(out) == 5
    assert all(any(own(k)[3:-3] in t for t in out) for k in "abcd")


def test_nulls_clashes_and_other_columns(spark, tmp_path):
    """Null ids and texts, missing columns and columns with working names: every stage ends with the columns of documents."""
    words = lambda k: " ".join(f"{k}word{i}" for i in range(40))
    rows = [(1, words("a"), 5, "x"), (None, words("b"), None, None), (2, None, 1, "y"), (None, None, None, None), (3, "", 0, "z"), (3, "", 0, "z"), (4, words("c") + " password=" + "k3Jx9Lq2Vb7Tz1Ws", 2, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, n_words long, __row string").withColumns({"kept": C.F.lit(1), "component_id": C.F.lit("c"), "redacted": C.F.lit("r"), "__group": C.F.lit(3)}).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    for k, (name, stage) in enumerate(C.STAGES[:-1]):
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.columns == C.COLUMNS
        alone = stage(spark, docs, "/root/testdata/sf0.001").count()
        assert alone == (3 if k == 0 else 7)  # rows without words are no copies of each other
    assert C.pack(spark, docs, "").count() == 7
    clean = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "secret_scan")).collect()}
    assert clean[4].endswith("<secret>") and clean[1] == words("a")
