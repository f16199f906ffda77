"""Hand-enumerated results on small graphs, properties, and file formats."""

import pytest
from pyspark.sql import functions as F

from duplexa import cli, sources
from duplexa.operators import baskets as B
from duplexa.operators import encode, evaluate, links, recommend, support, udf
from duplexa.operators.project import STRATEGIES, project
from duplexa.streaming import running_support, windowed_support

PAPER = {1: [1, 3, 4, 6, 7, 9, 13, 16], 2: [1, 2, 3, 6, 12, 13, 15], 3: [2, 6, 8, 10, 15], 4: [2, 3, 11, 16, 19], 5: [1, 3, 5, 6, 12, 13, 14, 16]}


def graph(spark, rows):
    return spark.createDataFrame(rows, "user bigint, item bigint")


@pytest.fixture(scope="module")
def paper(spark):
    return graph(spark, [(u, i) for u, items in PAPER.items() for i in items])


def pairs(df):
    return {(r["p1"], r["p2"]): r["support"] for r in df.collect()}


def paper_rows(spark):
    return graph(spark, [(1, 2), (3, 4)])


def test_paper_example(paper):
    three = {(1, 3): 3, (1, 6): 3, (1, 13): 3, (3, 6): 3, (3, 13): 3, (3, 16): 3, (6, 13): 3}
    assert pairs(project(paper, 3)) == three
    more = [(1, 12), (1, 16), (2, 3), (2, 6), (2, 15), (3, 12), (6, 12), (6, 15), (6, 16), (12, 13), (13, 16)]
    assert pairs(project(paper, 2)) == three | dict.fromkeys(more, 2)
    assert pairs(project(paper, 4)) == {}
    users = {(1, 2): 4, (1, 5): 5, (2, 3): 3, (2, 5): 5}
    assert pairs(project(paper, 3, user_space=True)) == users
    assert pairs(project(paper, 2, user_space=True)) == users | {(1, 4): 2, (2, 4): 2, (4, 5): 2}


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_strategies_agree(spark, paper, strategy):
    for s in (1, 2, 3):
        assert pairs(project(paper, s, strategy=strategy, rounds=3)) == pairs(project(paper, s))
        assert pairs(project(paper, s, prefilter=False)) == pairs(project(paper, s))
    swapped = paper.select(F.col("item").alias("user"), F.col("user").alias("item"))
    assert pairs(project(paper, 2, user_space=True, strategy=strategy)) == pairs(project(swapped, 2))


def test_group_dependent_prefixes(paper):
    got = {(r["user"], r["grp"]): r["prefix"] for r in B.group_dependent(paper, 3, 2).collect()}
    assert got == {
        (1, 0): [6, 3, 16], (1, 1): [6, 3, 16, 13, 1], (2, 0): [6, 3, 13, 2], (2, 1): [6, 3, 13, 2, 1], (3, 0): [6, 2], (4, 0): [3, 16, 2], (4, 1): [3], (5, 0): [6, 3, 16], (5, 1): [6, 3, 16, 13, 1],
    }
    assert [(r["item"], r["support"]) for r in support.f_list(paper, 3).collect()] == [(6, 4), (3, 4), (16, 3), (13, 3), (2, 3), (1, 3)]


def test_statistics_and_hubs(spark, paper):
    row = support.stats(support.support_rows(paper)).first()
    assert (round(row["mean"], 6), round(row["variance"], 6), row["threshold"]) == (1.941176, 1.308824, 7)
    for values, want in (([1, 2, 3, 4, 5], (3, 2.5, 10)), ([1] * 5, (1, 0, 1)), ([4], (4, 0, 4))):
        r = support.stats(spark.createDataFrame([(v,) for v in values], "support bigint")).first()
        assert (r["mean"], r["variance"], r["threshold"]) == want
    hub = graph(spark, [(u, i) for i in range(1, 41) for u in (i, i + 1)] + [(u, 999) for u in range(1, 101)])
    kept = project(hub, 1, hub_k=5.0)
    assert project(hub, 1).count() == 79 and kept.count() == 39 and set(pairs(kept).values()) == {1}
    assert project(hub, 2).count() == 40 and project(hub, 2, hub_k=5.0).count() == 0
    assert {r["side"]: (r["kept"], r["dropped"]) for r in support.node_report(hub, 1).collect()} == {"item": (40, 1), "user": (100, 0)}
    assert sum(r["wedges"] for r in support.wedges(paper, rounds=2).collect()) == 97


def test_set_and_bag(spark):
    e = graph(spark, [(1, 1), (1, 2), (1, 2), (1, 2), (2, 1), (2, 3), (2, 3), (3, 1), (3, 3), (3, 0), (4, 0), (4, 1), (None, 1), (5, None)])
    assert pairs(project(e, 1)) == {(0, 1): 2, (0, 3): 1, (1, 2): 1, (1, 3): 2}
    assert pairs(project(e, 1, semantics="bag")) == {(0, 1): 2, (0, 3): 1, (1, 2): 3, (1, 3): 3}
    lossy = graph(spark, [(1, 1), (1, 2), (1, 2), (1, 2)])
    assert pairs(project(lossy, 3, semantics="bag")) == {(1, 2): 3}
    assert pairs(project(lossy, 3, semantics="bag", prefilter=True)) == {}
    with pytest.raises(ValueError):
        project(e, 1, strategy="none")
    with pytest.raises(ValueError):
        project(e, 1, semantics="bag", strategy="baskets")
    assert project(e.limit(0), 1).count() == 0


def test_adjacency_and_diff(paper):
    two, three = project(paper, 2), project(paper, 3)
    flat = links.flattened(links.adjacency(two))
    assert flat.count() == 2 * two.count()
    assert pairs(links.canonicalise(flat, "item", "other")) == pairs(two)
    kinds = {r["kind"] for r in links.diff(two, three).collect()}
    assert kinds == {"missing"} and links.diff(two, two).count() == 0
    assert {r["kind"] for r in links.diff(three, two.withColumn("support", F.lit(9))).collect()} == {"wrong", "extra"}


def test_average_precision(spark):
    cases = [([1, 2, 3], [1, 3], 3, 5 / 6), ([1, 1, 2], [1, 2], 3, 5 / 6), ([9, 8], [1], 2, 0), ([1], [], 3, 1), ([], [1], 3, 0), ([1, 2, 3, 4], [4], 3, 0), ([5, 1, 2], [1, 2, 3, 4, 5, 6], 3, 1)]
    for predicted, actual, k, want in cases:
        a = spark.createDataFrame([(1, actual)], "user bigint, items array<bigint>")
        p = spark.createDataFrame([(1, predicted)], "user bigint, items array<bigint>")
        assert evaluate.map_at_k(a, p, k).first()["ap"] == pytest.approx(want)
    assert evaluate.map_at_k(a, p.limit(0), 3).first()["ap"] == 0


def test_similarity_and_popularity(paper):
    got = {(r["p1"], r["p2"]): (round(r["llr"], 6), round(r["similarity"], 6)) for r in recommend.llr_similarity(paper, 3).collect()}
    assert got[(1, 13)] == (6.730117, 0.870636) and got[(3, 6)] == (0.505343, 0.3357) and got[(1, 3)] == (2.231436, 0.69054)
    assert [r["item"] for r in recommend.top_popular(paper, 5).collect()] == [3, 6, 1, 2, 13]
    unseen = {}
    for r in recommend.popular_unseen(paper, 3).orderBy("user", "rank").collect():
        unseen.setdefault(r["user"], []).append(r["item"])
    assert unseen == {1: [2, 12, 15], 2: [16, 4, 5], 3: [3, 1, 13], 4: [6, 1, 13], 5: [2, 15, 4]}


def test_weighted_baskets(spark):
    rows = [([1, 3, 6, 13, 16],), ([1, 3, 6, 13, 16],), ([1, 2, 3, 6, 13],), ([2, 6],), ([2, 3, 16],)]
    got = {tuple(r["items"]): r["weight"] for r in B.weighted_baskets(spark.createDataFrame(rows, "items array<bigint>")).collect()}
    assert got == {(1, 3, 6, 13, 16): 2, (1, 2, 3, 6, 13): 1, (2, 6): 1, (2, 3, 16): 1}


def test_ranking_over_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("id"))
    got = sorted((r["id"], r["index"]) for r in encode.numbered(rows, "id").collect())
    assert [i for _, i in got] == list(range(1, 5001))
    assert encode.numbered(rows.limit(0), "id").count() == 0


def test_heavy_users(spark):
    """One user with many items, paired by blocks; every strategy gives the same pairs."""
    rows = spark.range(300).selectExpr("1 as user", "id as item").unionByName(spark.range(0, 300, 2).selectExpr("2 as user", "id as item")).unionByName(spark.range(0, 300, 5).selectExpr("3 as user", "id as item"))
    want = pairs(project(rows, 2, prefilter=False))
    for heavy in (7, 64, 299):
        assert pairs(project(rows, 2, heavy=heavy)) == want
        assert pairs(project(rows, 2, strategy="rounds", heavy=heavy)) == want
        assert project(rows, 2, symmetric=True, heavy=heavy).count() == 2 * len(want)
    assert len(want) == 150 * 149 // 2 + 60 * 59 // 2 - 30 * 29 // 2


def test_unseen_beyond_the_listed_places(spark, paper):
    for listed in (1, 8, 11, 1000):
        got = sorted(map(tuple, recommend.popular_unseen(paper, 3, listed).select("user", "item", "rank").collect()))
        assert got == sorted(map(tuple, recommend.popular_unseen(paper, 3).select("user", "item", "rank").collect()))


def test_frequent_pairs_of_another_algorithm(spark, paper):
    """Pairs equal the itemsets of length two that FP-growth finds."""
    from pyspark.ml.fpm import FPGrowth

    model = FPGrowth(itemsCol="items", minSupport=2 / 5, minConfidence=0.0).fit(B.baskets(paper))
    found = {tuple(sorted(r["items"])): r["freq"] for r in model.freqItemsets.where("size(items) = 2").collect()}
    assert found == pairs(project(paper, 2))


def test_typed_functions(spark):
    rows = spark.createDataFrame([(1, 9007199254740993, "a"), (2, None, "b"), (None, 5, "c")], "x bigint, y bigint, z string")
    add = udf.register(spark, "duplexa_add", lambda a, b: a + b, ["bigint", "bigint"], "bigint")
    want = [9007199254740994, None, None]
    assert [r[0] for r in rows.select(add(rows, "x", "y")).collect()] == want
    assert [r[0] for r in rows.selectExpr("duplexa_add(x, y)").collect()] == want
    assert rows.limit(0).select(add(rows, "x", "y")).count() == 0
    for wrong in (lambda: add(rows, "x"), lambda: add(rows, "x", "z"), lambda: udf.TypedFunction(lambda a: a, ["bigint", "bigint"], "bigint")):
        with pytest.raises(TypeError):
            wrong()


def test_map_and_reduce(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, None)], "id bigint, line string")
    for combine in (False, True):
        got = udf.map_reduce(rows, lambda r: [(w, 1) for w in (r["line"] or "").split()], "word string, n bigint", lambda k, v: [(k, sum(v))], "word string, n bigint", combine)
        assert sorted(map(tuple, got.collect())) == [("a", 2), ("b", 2)]


def test_listed_items(spark):
    rows = spark.createDataFrame([(1, 5, 2), (1, 4, 1), (1, 5, 3), (2, 7, 1), (None, 1, 1), (2, None, 2)], "user bigint, item bigint, at bigint")
    assert {r["user"]: r["items"] for r in B.listed(rows, "at").collect()} == {1: [4, 5, 5], 2: [7]}


def test_lists_in_splits(spark, tmp_path):
    """Lines of several files and splits keep their order; lists of two files meet by line."""
    values = [f"v{i}" if i % 7 else "" for i in range(5000)]
    for k in range(2):
        (tmp_path / f"part-{k}").write_text("".join(f"{v}\n" for v in values[k * 2500 : (k + 1) * 2500]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = [tuple(r) for r in sources.ordered_list(spark, str(tmp_path)).orderBy("pos").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(enumerate(values))
    (tmp_path / "a.txt").write_text("1 2\n\n3\n")
    (tmp_path / "b.txt").write_text("1\n4\n")
    both = sources.aligned_lists(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt")).orderBy("user")
    assert [tuple(r) for r in both.collect()] == [(0, [1, 2], [1]), (1, [], [4]), (2, [3], None)]


def test_files(spark, tmp_path):
    f = tmp_path / "edges.tsv"
    f.write_text("300\t7\t15\n22222\t1\t1\n22222\t2\t1\n1\t\t3\nx\t4\t1\n")
    assert sorted(map(tuple, sources.edges(spark, str(f)).collect())) == [(300, 7), (22222, 1), (22222, 2)]
    assert sorted(map(tuple, sources.edges(spark, str(f), user_space=True).collect())) == [(1, 22222), (2, 22222), (7, 300)]
    parsed = sources.parsed_triples(sources.lines(spark, str(f))).collect()
    assert (300, "7") in map(tuple, parsed) and len(parsed) == 4
    text = sources.basket_text(B.baskets(sources.edges(spark, str(f))))
    assert sorted(r[0] for r in text.collect()) == ["22222\t1 2", "300\t7"]
    (tmp_path / "p.csv").write_text("1,2\n1,3,4.5\n")
    assert sorted(map(tuple, sources.preferences(spark, str(tmp_path / "p.csv")).collect())) == [(1, 2, 1.0), (1, 3, 4.5)]
    (tmp_path / "users.txt").write_text("u2\nu1\n")
    assert [tuple(r) for r in sources.ordered_list(spark, str(tmp_path / "users.txt")).orderBy("pos").collect()] == [(0, "u2"), (1, "u1")]
    d = spark.createDataFrame([("  a   b ",)], "value string")
    assert tuple(sources.dictionary(d).first()) == ("a", "b")
    recs = spark.createDataFrame([("5\t[3:0.5,4:0.25]",), ("6\t8 9 ",), ("7\t",)], "value string")
    assert {r["user"]: r["items"] for r in sources.recommendations(recs).collect()} == {5: [3, 4], 6: [8, 9], 7: []}
    w = spark.createDataFrame([("u1".ljust(29) + "i1".ljust(15),), ("u2",)], "value string")
    assert sorted(map(tuple, sources.fixed_width(w).collect()), key=str) == [("u1", "i1"), ("u2", None)]
    c = sources.comma_baskets(spark.createDataFrame([("u", "f,a,c")], "user string, items string"), alphabet="abcdefghijklmnopqrstuvwxyz")
    assert sorted(r["item"] for r in c.collect()) == [0, 2, 5]
    sources.write_submission(spark.createDataFrame([(2, [1, 2])], "user bigint, items array<bigint>"), spark.createDataFrame([(0, 9), (1, 2)], "pos bigint, user bigint"), str(tmp_path / "sub"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "sub").glob("part-*"))) == "\n1 2\n"
    made = sources.write_table(paper_rows(spark), "duplexa_made", path=str(tmp_path / "made"))
    assert made.count() == 2 and "1\t2" in "".join(p.read_text() for p in (tmp_path / "made").glob("part-*"))
    spark.sql("DROP TABLE duplexa_made")
    table = sources.external_table(spark, "duplexa_external", str(f))
    assert table.count() == 5
    spark.sql("DROP TABLE duplexa_external")


def test_command_line(spark, tmp_path):
    f = tmp_path / "in.tsv"
    f.write_text("".join(f"{u}\t{i}\t1\n" for u, items in PAPER.items() for i in items))
    cli.main(["project", "--support", "3", str(f), str(tmp_path / "out")])
    assert spark.read.text(str(tmp_path / "out")).count() == 7
    cli.main(["popular", "--n", "3", str(f), str(tmp_path / "pop")])
    assert "1\t2 12 15" in {r[0] for r in spark.read.text(str(tmp_path / "pop")).collect()}


def test_streams(spark, tmp_path):
    rows = [(1, 7, "2024-01-01 00:00:00"), (2, 7, "2024-01-01 01:00:00"), (2, 8, "2024-01-05 01:00:00")]
    spark.createDataFrame(rows, "user bigint, item bigint, at string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("user bigint, item bigint, at timestamp").parquet(str(tmp_path / "s"))
    for name, df, mode in (("run_a", running_support(stream), "complete"), ("run_b", windowed_support(stream, "at"), "append")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {r["item"]: r["support"] for r in spark.table("run_a").collect()} == {7: 2, 8: 1}
    assert [(r["item"], r["support"]) for r in spark.table("run_b").collect()] == [(7, 2)]
