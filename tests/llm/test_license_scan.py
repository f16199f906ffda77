"""op6 against its SQL in DuckDB, inheritance by hand, the completeness of decisive words."""

import math
import random
import textwrap

import duckdb
from pyspark.sql import types as T

from duplexa.llm import license_scan as L

SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType()), T.StructField("license", T.StringType())])


def test_inheritance_and_edges(spark):
    prose = "some words about nothing in particular that fill the file and hold no notice"
    rows = [
        ("LICENSE", "All rights reserved.", "x"), ("a/LICENSE", "Licensed under the Apache License, Version 2.0.", "x"), ("a/main.c", prose, "x"), ("a/b/c/x.c", prose, "x"),
        ("a/b/own.c", "Released under the MIT License.\n" + prose * 3, "x"), ("d/y.c", prose, "x"), ("top.c", None, "x"), (None, prose, "x"), (None, "All rights reserved", "x"),
        ("ab/z.c", "", "x"), ("e/L1", "Released under the MIT License", "x"), ("e/L2", "All rights reserved", "x"), ("e/q.c", prose, "x"), ("e/q.c", prose, "x"),
    ]
    got = sorted(((r["path"], r["license"], r["origin"], r["origin_dir"], r["n_lines"]) for r in L.scan(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([
        ("LICENSE", "Proprietary", "own", "", 1), ("a/LICENSE", "Apache-2.0", "own", "a", 1), ("a/main.c", "Apache-2.0", "inherited", "a", 0), ("a/b/c/x.c", "Apache-2.0", "inherited", "a", 0),
        ("a/b/own.c", "MIT", "own", "a/b", 1), ("d/y.c", "Proprietary", "inherited", "", 0), ("top.c", "Proprietary", "inherited", "", 0), (None, None, None, None, 0), (None, "Proprietary", "own", None, 1),
        ("ab/z.c", "Proprietary", "inherited", "", 0), ("e/L1", "MIT", "own", "e", 1), ("e/L2", "Proprietary", "own", "e", 1), ("e/q.c", "MIT", "inherited", "e", 0), ("e/q.c", "MIT", "inherited", "e", 0),
    ], key=str)
    assert L.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_template_is_reached_without_a_decisive_word():
    r = random.Random(1)
    for _ in range(50):
        templates = L.vectors({w: r.uniform(1, 9) for w in L.VOCABULARY})
        words = L.decisive(templates, 0.75)
        for vector in templates.values():  # the best such a line can do is to be the template without those words
            assert math.sqrt(sum(x * x for w, x in vector.items() if w not in words)) < 0.75


def test_query_equals_sql(spark):
    for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
        want = sorted(con.execute(L.ORACLE_SQL).fetchall(), key=str)
        got = sorted((tuple(r) for r in L.op6_license_scan(spark, d).collect()), key=str)
        assert got == want
        assert len({x[1] for x in got}) > 3


def test_files_and_blocks(spark):
    """Licence files, wrapped headers, titles and tags, none of which is a line of TEMPLATES."""
    texts = {p.stem: p.read_text() for p in (L.Path(L.__file__).parent / "license_texts").glob("*.txt")}
    notices = {n: t for n, t in reversed(L.NOTICES) if len(t) > 400}
    code = "\n".join(f"value{i} = compute(alpha{i}, beta{i})" for i in range(300))
    wrap = lambda t: "\n".join("# " + x for x in textwrap.wrap(" ".join(t.split()), 60))
    rows = [(f"full/{n}/LICENSE", f"Copyright (c) 2020 Foo Bar\n\n{t}", n) for n, t in texts.items()]
    rows += [(f"top/{n}/x.py", f"{wrap(t)}\n{code}", n) for n, t in notices.items()] + [(f"middle/{n}/x.py", f"{code}\n{wrap(t)}\n{code}", n) for n, t in notices.items()]
    rows += [(f"inline/{n}/x.py", f"{code}\n{texts[n]}\n{code}", n) for n in ("MIT", "ISC", "BSD-2-Clause")]
    rows += [(f"tag/{n}/x.py", f"# SPDX-License-Identifier: {n}\n{code}", n) for n in ("MIT", "Apache-2.0", "GPL-3.0")]
    rows += [("title/1", f"The MIT License (MIT)\n{code}", "MIT"), ("wrapped/1", f"Released under\nthe MIT License\n{code}", "MIT"), ("foreign/1", f"# SPDX-License-Identifier: Zlib\n{code}", None), ("code/1", code, None)]
    rows += [("bsd/LICENSE", f"Copyright (c) 2020 Foo Bar\nAll rights reserved.\n\n{texts['BSD-3-Clause']}", "BSD-3-Clause"), ("bsd/x.py", code, "BSD-3-Clause"), (None, texts["MIT"], "MIT")] + [("twice/LICENSE", texts["MIT"], "MIT")] * 2
    filler = [(f"prose/{i}", " ".join(f"w{i}x{j}" for j in range(30)), None) for i in range(200)]
    got = L.scan(spark.createDataFrame([(p, t, "x") for p, t, _ in rows + filler], SCHEMA)).collect()
    want = sorted((str(p), str(n)) for p, _, n in rows + filler)
    assert sorted({(str(r["path"]), str(r["license"])) for r in got} ^ set(want)) == [] and len(got) == len(want)
    by = {r["path"]: r for r in got}
    assert by["bsd/x.py"]["origin"] == "inherited" and by["wrapped/1"]["n_lines"] == 2 and by["title/1"]["n_lines"] == 1


def test_plans_hold_few_literals(spark, monkeypatch):
    """A literal for each word of the templates, copied with every plan, fills the driver's heap."""
    made, lit = [], L.F.lit
    monkeypatch.setattr(L.F, "lit", lambda x: made.append(x) or lit(x))
    L.scan(spark.createDataFrame([("LICENSE", next(t for n, t in L.NOTICES if n == "GPL-3.0"), "x")], SCHEMA)).collect()
    assert len(made) < 1000


def test_tables_from_two_literals(spark):
    values = {"a": 1 / 3, "b2": 1e-17, "c": 12345.678901234567}
    assert spark.range(1).select(L._table(values), L._array(values), L._array([])).first()[:] == (values, list(values), [])
