"""Named queries over edges of customers and parts (or orders and parts), each with its SQL.

The SQL is written from the definitions, not from the DataFrame code, so that the two check each other. Floating
values are rounded alike on both sides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import range_group_of
from ..operators import baskets as B
from ..operators import encode, evaluate, links, recommend, support, udf
from ..operators.project import project
from ..sources.staging import stage_path, staged, written

QUERIES: dict = {}
SQL: dict[str, str] = {}

_RAW = "raw AS (SELECT o_custkey AS u, l_partkey AS i FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
_E = f"{_RAW}, e AS (SELECT DISTINCT u, i FROM raw)"
_OP = "e AS (SELECT DISTINCT l_orderkey AS u, l_partkey AS i FROM lineitem)"
_PAIRS = "pair AS (SELECT a.i AS p1, b.i AS p2, count(*) AS support FROM e a JOIN e b ON a.u = b.u AND a.i < b.i GROUP BY ALL)"
_RATED = f"{_RAW}, r AS (SELECT o_custkey AS u, l_partkey AS i, avg(l_quantity) AS x FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"
_LLR = """
    greatest(0, 2 * ((xl(k11) + xl(k12) + xl(k21) + xl(k22)) - (xl(k11 + k12) + xl(k21 + k22)) - (xl(k11 + k21) + xl(k12 + k22)) + xl(k11 + k12 + k21 + k22)))
"""


def _llr_sql() -> str:
    import re

    return re.sub(r"xl\(([^()]*)\)", r"(CASE WHEN \1 > 0 THEN (\1) * ln((\1)::DOUBLE) ELSE 0 END)", _LLR).strip()


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def raw_edges(spark: SparkSession, d: str) -> DataFrame:
    """Customer-part edges, one for each line."""
    o, l = _table(spark, d, "orders"), _table(spark, d, "lineitem")
    return o.join(l, o.o_orderkey == l.l_orderkey).select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"))


def order_edges(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("user"), F.col("l_partkey").alias("item")).distinct()


def ratings(spark: SparkSession, d: str) -> DataFrame:
    o, l = _table(spark, d, "orders"), _table(spark, d, "lineitem")
    return o.join(l, o.o_orderkey == l.l_orderkey).groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).agg(F.avg("l_quantity").alias("rating"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# projections

_SET2 = f"WITH {_E}, {_PAIRS} SELECT * FROM pair WHERE support >= 2"
_SET3 = f"WITH {_E}, {_PAIRS} SELECT * FROM pair WHERE support >= 3"


@query(_SET2)
def project_items_set(spark, d):
    return project(raw_edges(spark, d), 2)


@query(f"WITH {_RAW} SELECT a.i AS p1, b.i AS p2, count(*) AS support FROM raw a JOIN raw b ON a.u = b.u AND a.i < b.i GROUP BY ALL HAVING count(*) >= 2")
def project_items_bag(spark, d):
    return project(raw_edges(spark, d), 2, semantics="bag")


@query(_SET3)
def project_items_prefilter(spark, d):
    return project(raw_edges(spark, d), 3, prefilter=True)


@query(_SET3)
def project_items_unfiltered(spark, d):
    return project(raw_edges(spark, d), 3, prefilter=False)


@query(f"WITH {_RAW}, f AS (SELECT i FROM raw GROUP BY i HAVING count(*) >= 4), k AS (SELECT * FROM raw WHERE i IN (SELECT i FROM f)) SELECT a.i AS p1, b.i AS p2, count(*) AS support FROM k a JOIN k b ON a.u = b.u AND a.i < b.i GROUP BY ALL HAVING count(*) >= 4")
def project_items_bag_prefilter(spark, d):
    return project(raw_edges(spark, d), 4, semantics="bag", prefilter=True)


@query(f"WITH {_OP} SELECT a.u AS p1, b.u AS p2, count(*) AS support FROM e a JOIN e b ON a.i = b.i AND a.u < b.u GROUP BY ALL HAVING count(*) >= 2")
def project_users(spark, d):
    return project(order_edges(spark, d), 2, user_space=True)


@query(f"WITH {_E} SELECT a.i AS p1, b.i AS p2, count(*) AS support FROM e a JOIN e b ON a.u = b.u AND a.i <> b.i GROUP BY ALL HAVING count(*) >= 3")
def project_symmetric(spark, d):
    return project(raw_edges(spark, d), 3, symmetric=True)


@query(_SET3)
def project_basket_hof(spark, d):
    return project(raw_edges(spark, d), 3, strategy="baskets")


@query(_SET3)
def project_weighted(spark, d):
    return project(raw_edges(spark, d), 3, strategy="weighted")


@query(_SET3)
def project_rounds(spark, d):
    return project(raw_edges(spark, d), 3, strategy="rounds", rounds=4)


@query(_SET3)
def project_pfp_groups(spark, d):
    return project(raw_edges(spark, d), 3, strategy="groups", rounds=4)


_HUB = f"""{_RAW}, di AS (SELECT i, count(*) AS c FROM raw GROUP BY i HAVING count(*) >= 2), du AS (SELECT u, count(*) AS c FROM raw GROUP BY u),
    ti AS (SELECT floor(avg(c) + 1 * sqrt(coalesce(var_samp(c), 0))) AS t FROM di), tu AS (SELECT floor(avg(c) + 1 * sqrt(coalesce(var_samp(c), 0))) AS t FROM du)"""


@query(f"WITH {_HUB}, e AS (SELECT DISTINCT raw.u, raw.i FROM raw JOIN di USING (i) JOIN du USING (u), ti, tu WHERE di.c <= ti.t AND du.c <= tu.t), {_PAIRS} SELECT * FROM pair WHERE support >= 2")
def project_megahub_k1(spark, d):
    return project(raw_edges(spark, d), 2, hub_k=1.0)


@query(f"WITH {_HUB} SELECT i AS item, c AS support FROM di, ti WHERE c <= t")
def hub_filtered_nodes(spark, d):
    return support.without_hubs(support.support_rows(raw_edges(spark, d)).where("support >= 2"), 1.0)


@query(f"WITH {_HUB} SELECT 'item' AS side, count(*) FILTER (c <= t) AS kept, count(*) FILTER (c > t) AS dropped FROM di, ti UNION ALL SELECT 'user', count(*) FILTER (c <= t), count(*) FILTER (c > t) FROM du, tu")
def node_filter_report(spark, d):
    return support.node_report(raw_edges(spark, d), 2, 1.0)


@query(f"WITH {_E}, {_PAIRS}, s AS (SELECT * FROM pair WHERE support >= 3) SELECT p1 AS item, p2 AS other, support FROM s UNION ALL SELECT p2, p1, support FROM s")
def adjacency_flat(spark, d):
    return links.flattened(links.adjacency(project(raw_edges(spark, d), 3)))


@query(f"WITH {_E}, {_PAIRS}, s AS (SELECT * FROM pair WHERE support >= 3) SELECT item, count(*)::INTEGER AS n FROM (SELECT p1 AS item FROM s UNION ALL SELECT p2 FROM s) GROUP BY item")
def adjacency_size(spark, d):
    return links.adjacency(project(raw_edges(spark, d), 3)).select("item", F.size("adj").alias("n"))


@query(f"WITH {_E}, {_PAIRS}, s AS (SELECT * FROM pair WHERE support >= 4) SELECT item, string_agg(concat(other, ':', support), ' ' ORDER BY other) AS adj FROM (SELECT p1 AS item, p2 AS other, support FROM s UNION ALL SELECT p2, p1, support FROM s) GROUP BY item")
def adjacency_lists(spark, d):
    """The neighbours of each item in their order."""
    adj = links.adjacency(project(raw_edges(spark, d), 4))
    return adj.select("item", F.array_join(F.transform("adj", lambda x: F.concat(x["other"].cast("string"), F.lit(":"), x["support"].cast("string"))), " ").alias("adj"))


@query(f"WITH {_E}, {_PAIRS}, s AS (SELECT * FROM pair WHERE support >= 3) SELECT concat_ws(chr(9), item, other, support) AS value FROM (SELECT p1 AS item, p2 AS other, support FROM s UNION ALL SELECT p2, p1, support FROM s)")
def link_lines(spark, d):
    return sources.link_text(links.adjacency(project(raw_edges(spark, d), 3)))


@query(_SET2)
def hive_ctas_projection(spark, d):
    """A delimited table made from an external one by a query, and read."""
    raw, made = stage_path(spark, "raw"), f"duplexa_links_{uuid.uuid4().hex}"
    name = f"duplexa_raw_{uuid.uuid4().hex}"
    sources.write_tsv(raw_edges(spark, d).distinct().select("user", "item", F.lit(1).alias("cnt")), raw)
    sources.external_table(spark, name, raw)
    pairs = spark.sql(f"SELECT a.item AS p1, b.item AS p2, count(*) AS support FROM {name} a JOIN {name} b ON a.user = b.user WHERE a.item < b.item GROUP BY a.item, b.item HAVING count(*) >= 2")
    return sources.write_table(pairs, made, path=stage_path(spark, "links"))


# support and statistics


@query(f"WITH {_E} SELECT i AS item, count(*) AS support FROM e GROUP BY i")
def item_support_distinct(spark, d):
    return support.support_distinct(raw_edges(spark, d))


@query(f"WITH {_RAW} SELECT i AS item, count(*) AS support FROM raw GROUP BY i")
def item_support_rows(spark, d):
    return support.support_rows(raw_edges(spark, d))


@query(f"WITH {_RAW} SELECT u AS \"user\", count(*) AS support FROM raw GROUP BY u")
def user_degree(spark, d):
    return support.support_rows(raw_edges(spark, d), "user")


@query(f"WITH {_E} SELECT i AS item, count(*) AS support FROM e GROUP BY i HAVING count(*) >= 20")
def f_list(spark, d):
    return support.f_list(raw_edges(spark, d), 20)


@query(f"WITH {_E}, g AS (SELECT i, count(*) AS c FROM e GROUP BY i) SELECT count(*) AS n, round(avg(c), 6) AS mean, round(coalesce(var_samp(c), 0), 6) AS variance, floor(avg(c) + 5 * sqrt(coalesce(var_samp(c), 0)))::BIGINT AS threshold FROM g")
def graph_stats(spark, d):
    return support.stats(support.support_distinct(raw_edges(spark, d))).withColumns({"mean": F.round("mean", 6), "variance": F.round("variance", 6)})


@query(f"WITH {_RAW}, g AS (SELECT u, count(*) AS c FROM raw GROUP BY u) SELECT floor(avg(c) + 1 * sqrt(var_samp(c)))::BIGINT AS threshold FROM g")
def mega_hub_threshold(spark, d):
    return support.stats(support.support_rows(raw_edges(spark, d), "user"), 1.0).select("threshold")


@query(f"WITH {_E}, o AS (SELECT i % 4 AS round, count(*) OVER (PARTITION BY u ORDER BY i DESC) - 1 AS after FROM e) SELECT round, sum(after)::BIGINT AS wedges FROM o GROUP BY round")
def wedge_volume(spark, d):
    return support.wedges(raw_edges(spark, d), rounds=4)


@query(f"WITH {_E}, g AS (SELECT i FROM e GROUP BY i HAVING count(*) >= 20) SELECT ceil(count(*) / 8.0)::BIGINT AS max_per_group FROM g")
def max_per_group(spark, d):
    return support.max_per_group(raw_edges(spark, d), 20, 8)


# baskets


@query(f"WITH {_E} SELECT i AS item, count(*) AS support FROM e GROUP BY i")
def basket_explode_count(spark, d):
    return B.exploded_counts(B.baskets(raw_edges(spark, d)))


@query(f"WITH {_E} SELECT concat(u, chr(9), string_agg(i::VARCHAR, ' ' ORDER BY i)) AS value FROM e GROUP BY u")
def baskets_text(spark, d):
    return sources.basket_text(B.baskets(raw_edges(spark, d)))


@query(f"WITH {_OP}, b AS (SELECT u, string_agg(i::VARCHAR, ' ' ORDER BY i) AS items FROM e GROUP BY u) SELECT items, count(*) AS weight FROM b GROUP BY items")
def weighted_baskets(spark, d):
    w = B.weighted_baskets(B.baskets(order_edges(spark, d)))
    return w.select(F.array_join(F.transform("items", lambda x: x.cast("string")), " ").alias("items"), "weight")


_RANKED = f"""{_E}, g AS (SELECT i, count(*) AS c FROM e GROUP BY i HAVING count(*) >= 25),
    o AS (SELECT u, i, row_number() OVER (PARTITION BY u ORDER BY c DESC, i DESC) AS pos FROM e JOIN g USING (i))"""


@query(f"WITH {_RANKED}, p AS (SELECT u, i % 4 AS grp, max(pos) AS n FROM o GROUP BY u, i % 4) SELECT p.u AS \"user\", grp, string_agg(i::VARCHAR, ' ' ORDER BY pos) AS prefix FROM p JOIN o ON o.u = p.u AND pos <= n GROUP BY p.u, grp")
def group_dependent_transactions(spark, d):
    return B.group_dependent(raw_edges(spark, d), 25, 4).select("user", "grp", F.array_join(F.transform("prefix", lambda x: x.cast("string")), " ").alias("prefix"))


@query(f"WITH {_RANKED} SELECT u AS \"user\", string_agg(i::VARCHAR, ' ' ORDER BY pos) AS items FROM o GROUP BY u")
def ranked_baskets(spark, d):
    return B.ranked_baskets(raw_edges(spark, d), 25).select("user", F.array_join(F.transform("items", lambda x: x.cast("string")), " ").alias("items"))


@query("SELECT o_custkey AS \"user\", string_agg(l_partkey::VARCHAR, ' ' ORDER BY o_orderkey * 8 + l_linenumber, l_partkey) AS items FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey")
def listed_items(spark, d):
    """Every user's items in the order of order and line, repeats kept."""
    o, l = _table(spark, d, "orders"), _table(spark, d, "lineitem")
    rows = o.join(l, o.o_orderkey == l.l_orderkey).select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), (F.col("o_orderkey") * 8 + F.col("l_linenumber")).alias("at"))
    return B.listed(rows, "at").select("user", F.array_join(F.transform("items", lambda x: x.cast("string")), " ").alias("items"))


@query(f"WITH {_RANKED}, p AS (SELECT u, i % 4 AS grp, max(pos) AS n FROM o GROUP BY u, i % 4) SELECT count(*) AS n, round(avg(n), 6) AS mean_length FROM p")
def transaction_averages(spark, d):
    return B.transaction_averages(raw_edges(spark, d), 25, 4).withColumn("mean_length", F.round("mean_length", 6))


# ingest and dictionaries

_NAMED = "named AS (SELECT c_name AS u, p_name AS i FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)"


def named_edges(spark: SparkSession, d: str) -> DataFrame:
    users = _table(spark, d, "customer").select(F.col("c_custkey").alias("user"), "c_name")
    items = _table(spark, d, "part").select(F.col("p_partkey").alias("item"), "p_name")
    return raw_edges(spark, d).join(users, "user").join(items, "item").select(F.col("c_name").alias("user"), F.col("p_name").alias("item"))


@query(f"WITH {_NAMED}, us AS (SELECT u, row_number() OVER (ORDER BY u) AS n FROM (SELECT DISTINCT u FROM named)), it AS (SELECT i, row_number() OVER (ORDER BY i) AS n FROM (SELECT DISTINCT i FROM named)) SELECT us.n AS \"user\", it.n AS item FROM named JOIN us USING (u) JOIN it USING (i)")
def dictionary_encode_edges(spark, d):
    e = named_edges(spark, d)
    return encode.encode_edges(e, encode.numbered(e, "user"), encode.numbered(e, "item"))


@query(f"WITH {_NAMED} SELECT row_number() OVER (ORDER BY i) AS \"index\", i AS id FROM (SELECT DISTINCT i FROM named)")
def numbered_items(spark, d):
    return encode.numbered(named_edges(spark, d), "item")


@query(f"WITH {_RAW}, us AS (SELECT c_custkey AS u, c_custkey + 1 AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')), it AS (SELECT p_partkey AS i, p_partkey + 1 AS n FROM part WHERE p_size <= 25) SELECT us.n AS \"user\", it.n AS item, l_linenumber AS cnt FROM (SELECT o_custkey AS u, l_partkey AS i, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey) r JOIN us USING (u) JOIN it USING (i)")
def known_id_filter(spark, d):
    users = _table(spark, d, "customer").where("c_mktsegment IN ('BUILDING', 'MACHINERY')").select((F.col("c_custkey") + 1).alias("index"), F.col("c_custkey").alias("id"))
    items = _table(spark, d, "part").where("p_size <= 25").select((F.col("p_partkey") + 1).alias("index"), F.col("p_partkey").alias("id"))
    o, l = _table(spark, d, "orders"), _table(spark, d, "lineitem")
    counted = o.join(l, o.o_orderkey == l.l_orderkey).select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("cnt"))
    return encode.encode_edges(counted, users, items)


@query("SELECT DISTINCT o_custkey::VARCHAR AS \"user\", l_partkey::VARCHAR AS item FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def fixed_width_edges(spark, d):
    line = F.concat(F.rpad(F.col("user").cast("string"), 29, " "), F.rpad(F.col("item").cast("string"), 15, " "))
    return sources.fixed_width(raw_edges(spark, d).select(line.alias("value")))


@query(f"WITH {_OP} SELECT u AS \"user\", i % 26 AS item FROM e")
def comma_basket_explode(spark, d):
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    letters = F.transform("items", lambda x: F.substring(F.lit(alphabet), (x % 26 + 1).cast("int"), F.lit(1)))
    return sources.comma_baskets(B.baskets(order_edges(spark, d)).select("user", F.array_join(letters, ",").alias("items")), alphabet=alphabet)


@query("SELECT DISTINCT l_orderkey AS \"user\", l_partkey::VARCHAR AS item FROM lineitem")
def triple_lines(spark, d):
    rows = order_edges(spark, d).select(F.concat_ws("\t", F.col("user").cast("string"), F.col("item").cast("string"), F.lit("1")).alias("value"))
    return sources.parsed_triples(rows)


@query(f"WITH {_E} SELECT u AS \"user\", i AS item, 1.0::DOUBLE AS rating FROM e")
def boolean_preferences(spark, d):
    return sources.boolean_preferences(raw_edges(spark, d))


# files, written and read back


def _stored(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """Delimited files of some rows."""
    path = stage_path(spark, name)
    sources.write_tsv(rows, path)
    return path


def _texts(spark: SparkSession, rows: DataFrame, name: str) -> str:
    path = stage_path(spark, name)
    rows.write.text(path)
    return path


def _lines(spark: SparkSession, d: str) -> DataFrame:
    o, l = _table(spark, d, "orders"), _table(spark, d, "lineitem")
    return o.join(l, o.o_orderkey == l.l_orderkey).select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("cnt"))


_TRIPLES = 'SELECT o_custkey AS "user", l_partkey AS item, l_linenumber AS cnt FROM orders JOIN lineitem ON o_orderkey = l_orderkey'


@query(_TRIPLES)
def tsv_triples(spark, d):
    return sources.triples(spark, _stored(spark, _lines(spark, d), "triples"))


@query("SELECT l_partkey AS \"user\", o_custkey AS item FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def tsv_edges_swapped(spark, d):
    return sources.edges(spark, _stored(spark, _lines(spark, d), "triples"), user_space=True)


@query("SELECT c_name AS \"user\", p_name AS item FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey")
def tsv_string_edges(spark, d):
    return sources.string_edges(spark, _stored(spark, named_edges(spark, d), "named"))


@query("SELECT DISTINCT o_custkey::VARCHAR AS \"user\", l_partkey::VARCHAR AS item FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def fixed_width_file(spark, d):
    line = F.concat(F.rpad(F.col("user").cast("string"), 29, " "), F.rpad(F.col("item").cast("string"), 15, " "))
    return sources.fixed_width(sources.lines(spark, _texts(spark, raw_edges(spark, d).select(line), "lines")))


@query(_TRIPLES)
def external_table(spark, d):
    return sources.external_table(spark, f"duplexa_ext_{uuid.uuid4().hex}", _stored(spark, _lines(spark, d), "external"))


@query(f"WITH {_RATED} SELECT u AS \"user\", i AS item, CASE WHEN x > 25 THEN x ELSE 1.0 END AS rating FROM r")
def preference_file(spark, d):
    """Ratings at or below 25 are left out of the file and read as 1."""
    rated = ratings(spark, d).select("user", "item", F.when(F.col("rating") > 25, F.col("rating")).alias("rating"))
    path = stage_path(spark, "preferences")
    rated.write.csv(path)
    return sources.preferences(spark, path)


@query(f"WITH {_E} SELECT u AS \"user\", string_agg(i::VARCHAR, ' ' ORDER BY i) AS items FROM e GROUP BY u")
def stored_baskets(spark, d):
    path = stage_path(spark, "baskets")
    B.baskets(raw_edges(spark, d)).write.parquet(path)
    return sources.baskets(spark, path).select("user", F.array_join(F.transform("items", lambda x: x.cast("string")), " ").alias("items"))


@query(f"WITH {_RAW} SELECT i AS item, count(*) AS support FROM raw GROUP BY i HAVING count(*) >= 30")
def stored_frequent(spark, d):
    """Stored counts, read with their threshold."""
    path = stage_path(spark, "counts")
    support.support_rows(raw_edges(spark, d)).write.parquet(path)
    return sources.stored_counts(spark, path, 30)


@query("SELECT c_custkey::VARCHAR AS key, c_mktsegment AS val FROM customer")
def dictionary_file(spark, d):
    rows = _table(spark, d, "customer").select(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit("   "), F.col("c_mktsegment")))
    return sources.dictionary(sources.lines(spark, _texts(spark, rows, "dictionary")))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey::VARCHAR AS value FROM orders")
def ordered_list_file(spark, d):
    rows = _table(spark, d, "orders").orderBy("o_orderkey").select(F.col("o_orderkey").cast("string"))
    return sources.ordered_list(spark, _texts(spark, rows, "ordered"))


@query(f"WITH {_E}, {_PAIRS} SELECT concat_ws(chr(9), p1, p2, support) AS value FROM pair WHERE support >= 4")
def link_files(spark, d):
    """Links as lines of files that were there before and are replaced."""
    path = stage_path(spark, "links")
    for least in (5, 4):
        sources.write_tsv(project(raw_edges(spark, d), least), path)
    return sources.lines(spark, path)


@query(f"WITH {_E}, {_PAIRS} SELECT * FROM pair WHERE support >= 4")
def staged_links(spark, d):
    return staged(project(raw_edges(spark, d), 4), "links")


@query("WITH raw AS (SELECT o_custkey AS u, l_partkey AS i FROM orders JOIN lineitem ON o_orderkey = l_orderkey), l AS (SELECT u, string_agg(i::VARCHAR, ' ' ORDER BY i) AS items FROM (SELECT DISTINCT u, i FROM raw) GROUP BY u) SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, coalesce(items, '') AS value FROM customer LEFT JOIN l ON u = c_custkey")
def submission_file(spark, d):
    """Lists in the order of the customers, empty lines for those without one."""
    users = _table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_custkey").alias("user"))
    path = stage_path(spark, "submission")
    sources.write_submission(B.baskets(raw_edges(spark, d)), users, path)
    return sources.ordered_list(spark, path)


@query(f"WITH {_E} SELECT u AS \"user\", i AS item FROM e")
def recommendation_file(spark, d):
    text = sources.recommendation_text(B.baskets(raw_edges(spark, d)))
    return sources.recommendations(sources.lines(spark, _texts(spark, text, "recommendations"))).select("user", F.explode("items").alias("item"))


@query(f"WITH {_E}, t AS (SELECT i, count(*) AS c FROM e GROUP BY i), top AS (SELECT i, row_number() OVER (ORDER BY c DESC, i) AS r FROM t QUALIFY r <= 100), us AS (SELECT u, row_number() OVER (ORDER BY u) - 1 AS pos, count(*) AS n FROM e GROUP BY u), h AS (SELECT u, r, row_number() OVER (PARTITION BY u ORDER BY r) AS hits FROM e JOIN top USING (i)) SELECT pos AS \"user\", round(coalesce(sum(hits / r::DOUBLE), 0) / least(any_value(n), 100), 9) AS ap FROM us LEFT JOIN h USING (u) GROUP BY pos")
def aligned_files(spark, d):
    """Average precision of two files matched by line."""
    e = raw_edges(spark, d)
    truth = B.baskets(e).orderBy("user")
    top = support.support_distinct(e).orderBy(F.desc("support"), "item").limit(100).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("support")).alias("s"), "item"))), lambda x: x["item"]).alias("items"))
    text = lambda df: df.select(F.array_join(F.transform("items", lambda x: x.cast("string")), " "))
    actual = _texts(spark, text(truth), "actual")
    predicted = _texts(spark, text(truth.select("user").crossJoin(F.broadcast(top)).orderBy("user")), "predicted")
    both = sources.aligned_lists(spark, predicted, actual)
    return evaluate.map_at_k(both.select("user", F.col("actual").alias("items")), both.select("user", F.col("predicted").alias("items")), 100).select("user", F.round("ap", 9).alias("ap"))


@query("SELECT DISTINCT l_partkey AS item, l_partkey // 100 AS grp FROM lineitem")
def range_groups(spark, d):
    return _table(spark, d, "lineitem").select(F.col("l_partkey").alias("item")).distinct().withColumn("grp", range_group_of("item", 100))


# popularity and recommendation files

_POP = f"{_RAW}, pop AS (SELECT i, count(*) AS support, row_number() OVER (ORDER BY count(*) DESC, i) AS rank FROM raw GROUP BY i)"


@query(f"WITH {_POP} SELECT i AS item, support, rank FROM pop")
def popularity_rank(spark, d):
    return recommend.popularity(raw_edges(spark, d))


@query(f"WITH {_POP} SELECT i AS item, support FROM pop WHERE rank <= 500")
def popularity_topk(spark, d):
    return recommend.top_popular(raw_edges(spark, d), 500)



@query(f"WITH {_POP}, us AS (SELECT DISTINCT u FROM raw), un AS (SELECT us.u, pop.i, row_number() OVER (PARTITION BY us.u ORDER BY pop.rank) AS rank FROM us CROSS JOIN pop LEFT JOIN (SELECT DISTINCT u, i FROM raw) s ON s.u = us.u AND s.i = pop.i WHERE s.u IS NULL) SELECT u AS \"user\", i AS item, rank::INTEGER AS rank FROM un WHERE rank <= 500")
def popularity_unseen(spark, d):
    return recommend.popular_unseen(raw_edges(spark, d), 500)


@query(f"WITH {_POP}, top AS (SELECT string_agg(i::VARCHAR, ' ' ORDER BY rank) AS items FROM pop WHERE rank <= 10), own AS (SELECT u, string_agg(DISTINCT i::VARCHAR, ' ' ORDER BY i::VARCHAR) AS items FROM raw JOIN part ON p_partkey = i WHERE p_size = 1 GROUP BY u) SELECT c_custkey AS \"user\", coalesce(own.items, top.items) AS items, own.items IS NULL AS fallback FROM customer LEFT JOIN own ON own.u = c_custkey, top")
def recs_fallback(spark, d):
    e = raw_edges(spark, d)
    small = _table(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("item"))
    own = e.join(small, "item").groupBy("user").agg(F.transform(F.array_sort(F.collect_set(F.col("item").cast("string"))), lambda x: x.cast("bigint")).alias("items"))
    out = recommend.with_fallback(_table(spark, d, "customer").select(F.col("c_custkey").alias("user")), own, recommend.top_popular(e, 10))
    return out.select("user", F.array_join(F.transform("items", lambda x: x.cast("string")), " ").alias("items"), "fallback")


@query("WITH n AS (SELECT c_custkey, count(DISTINCT l_partkey) AS n FROM customer LEFT JOIN (orders JOIN lineitem ON o_orderkey = l_orderkey) ON o_custkey = c_custkey GROUP BY c_custkey) SELECT count(*) AS n, count(*) FILTER (n = 0) AS empty, count(*) FILTER (n <> 40) AS wrong_length FROM n")
def recs_verify(spark, d):
    users = _table(spark, d, "customer").select(F.col("c_custkey").alias("user"))
    return evaluate.verify(users.join(B.baskets(raw_edges(spark, d)), "user", "left"), 40)


@query(f"WITH {_OP} SELECT u AS \"user\", i AS item FROM e")
def recs_parse_scored(spark, d):
    scored = F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: F.concat(x.cast("string"), F.lit(":0.5"))), ","), F.lit("]"))
    rows = B.baskets(order_edges(spark, d)).select(F.concat_ws("\t", F.col("user").cast("string"), scored).alias("value"))
    return sources.recommendations(rows).select("user", F.explode("items").alias("item"))


# links


@query(f"WITH {_E}, {_PAIRS}, s AS (SELECT * FROM pair WHERE support >= 2), b AS (SELECT a.i AS p1, c.i AS p2, count(*) AS support FROM raw a JOIN raw c ON a.u = c.u AND a.i < c.i GROUP BY ALL HAVING count(*) >= 3) SELECT p1, p2, s.support AS expected, b.support AS actual, CASE WHEN b.support IS NULL THEN 'missing' WHEN s.support IS NULL THEN 'extra' ELSE 'wrong' END AS kind FROM s FULL JOIN b USING (p1, p2) WHERE s.support IS DISTINCT FROM b.support")
def projection_diff(spark, d):
    e = raw_edges(spark, d)
    return links.diff(project(e, 2), project(e, 3, semantics="bag"))


@query("SELECT least(l_partkey, l_suppkey) AS p1, greatest(l_partkey, l_suppkey) AS p2, l_linenumber AS support FROM lineitem")
def canonicalise_links(spark, d):
    rows = _table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_linenumber").alias("support"))
    return links.canonicalise(rows)


@query("SELECT least(l_partkey, l_suppkey) AS p1, greatest(l_partkey, l_suppkey) AS p2, max(l_linenumber) AS support FROM lineitem GROUP BY ALL")
def best_partial_links(spark, d):
    return links.best_links(canonicalise_links(spark, d))


@query(f"WITH {_RAW}, c AS (SELECT i, u, count(*) AS n FROM raw GROUP BY i, u HAVING count(*) >= 2) SELECT i AS item, string_agg(concat(u, ':', n), ' ' ORDER BY u) AS bag FROM c GROUP BY i")
def counter_udaf(spark, d):
    bags = udf.counter(raw_edges(spark, d), "item", "user", 2)
    return bags.select("item", F.array_join(F.transform("bag", lambda x: F.concat(x["user"].cast("string"), F.lit(":"), x["count"].cast("string"))), " ").alias("bag"))


@query("SELECT DISTINCT l_partkey AS item, l_partkey % 7 AS grp FROM lineitem")
def typed_udf(spark, d):
    udf.register(spark, "duplexa_group", lambda x, g: x % g, ["bigint", "bigint"], "bigint")
    return _table(spark, d, "lineitem").select(F.col("l_partkey").alias("item")).distinct().withColumn("grp", F.expr("duplexa_group(item, 7L)"))


@query("SELECT l_partkey AS item, count(*) AS support FROM lineitem GROUP BY l_partkey")
def user_map_reduce(spark, d):
    """Counting by user code: a mapper, a combiner and a reducer."""
    rows = _table(spark, d, "lineitem").select(F.col("l_partkey").alias("item"))
    return udf.map_reduce(rows, lambda r: [(r["item"], 1)], "item bigint, one bigint", lambda k, v: [(k, sum(v))], "item bigint, support bigint", combine=True)


# similarities and neighbourhoods

def _similar(least: int) -> str:
    return f"""{_E}, {_PAIRS}, g AS (SELECT i, count(*) AS c FROM e GROUP BY i), t AS (SELECT count(DISTINCT u) AS n FROM e),
    k AS (SELECT p1, p2, support, support AS k11, b.c - support AS k12, a.c - support AS k21, n - a.c - b.c + support AS k22 FROM pair JOIN g a ON a.i = p1 JOIN g b ON b.i = p2, t WHERE support >= {least}),
    llr AS (SELECT p1, p2, support, {_llr_sql()} AS llr FROM k), sim AS (SELECT p1, p2, support, llr, 1 - 1 / (1 + llr) AS s FROM llr),
    both_ways AS (SELECT p1 AS x, p2 AS y, s FROM sim UNION ALL SELECT p2, p1, s FROM sim)"""


_SIM = _similar(1)


@query(f"WITH {_similar(2)} SELECT p1, p2, support, round(llr, 6) AS llr, round(s, 6) AS similarity FROM sim")
def llr_item_similarity(spark, d):
    return recommend.llr_similarity(raw_edges(spark, d), 2).withColumns({"llr": F.round("llr", 6), "similarity": F.round("similarity", 6)})


@query(f"WITH {_SIM}, sc AS (SELECT e.u, y AS i, round(sum(s), 6) AS score FROM e JOIN both_ways ON e.i = x GROUP BY ALL), r AS (SELECT sc.*, row_number() OVER (PARTITION BY u ORDER BY score DESC, i) AS rank FROM sc WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.u = sc.u AND e.i = sc.i)) SELECT u AS \"user\", i AS item, score, rank::INTEGER AS rank FROM r WHERE rank <= 10")
def llr_item_recommend(spark, d):
    return recommend.item_based(raw_edges(spark, d), 10, 1)


_USIM = _SIM.replace("e AS (SELECT DISTINCT u, i FROM raw)", "e AS (SELECT DISTINCT i AS u, u AS i FROM raw)")
_NEAR = "near AS (SELECT x, y, s, row_number() OVER (PARTITION BY x ORDER BY round(s, 9) DESC, y) AS place FROM both_ways QUALIFY place <= 20)"


@query(f"WITH {_USIM}, {_NEAR} SELECT x, y, place::INTEGER AS place, round(s, 6) AS similarity FROM near")
def llr_user_neighbourhood(spark, d):
    return recommend.user_neighbours(raw_edges(spark, d), 20, 1).select("x", "y", "place", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_USIM}, {_NEAR}, sc AS (SELECT x AS u, e.u AS i, round(sum(s), 6) AS score FROM near JOIN e ON e.i = y GROUP BY ALL), r AS (SELECT sc.*, row_number() OVER (PARTITION BY u ORDER BY score DESC, i) AS rank FROM sc WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.i = sc.u AND e.u = sc.i)) SELECT u AS \"user\", i AS item, score, rank::INTEGER AS rank FROM r WHERE rank <= 10")
def llr_user_recommend(spark, d):
    return recommend.user_based(raw_edges(spark, d), 10, 20, 1)


_PEARSON = f"""{_RATED}, p AS (SELECT a.u AS u1, b.u AS u2, count(*) AS common, corr(a.x, b.x) AS s, var_pop(a.x) AS va, var_pop(b.x) AS vb FROM r a JOIN r b ON a.i = b.i AND a.u < b.u GROUP BY ALL HAVING count(*) >= 3),
    q AS (SELECT u1, u2, common, s FROM p WHERE va > 1e-9 AND vb > 1e-9 AND s IS NOT NULL AND NOT isnan(s))"""


@query(f"WITH {_PEARSON} SELECT u1, u2, common, round(s, 5) + 0.0 AS similarity FROM q")
def pearson_user_similarity(spark, d):
    return recommend.pearson(ratings(spark, d), 3).withColumn("similarity", F.round("similarity", 5) + F.lit(0.0))


@query(f"WITH {_PEARSON}, w AS (SELECT u1 AS x, u2 AS y, s FROM q UNION ALL SELECT u2, u1, s FROM q), near AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(s, 9) DESC, y) AS place FROM w QUALIFY place <= 100), sc AS (SELECT near.x AS u, r.i, round(sum(s * r.x) / sum(s), 6) AS score FROM near JOIN r ON r.u = y WHERE round(s, 9) > 0 GROUP BY ALL), f AS (SELECT sc.*, row_number() OVER (PARTITION BY u ORDER BY score DESC, i) AS rank FROM sc WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.u = sc.u AND r.i = sc.i)) SELECT u AS \"user\", i AS item, score, rank::INTEGER AS rank FROM f WHERE rank <= 20")
def pearson_recommend(spark, d):
    return recommend.pearson_based(ratings(spark, d), 20, 100, 3)


# evaluation

_TOP = f"{_POP}, top AS (SELECT i, rank FROM pop WHERE rank <= 500)"


@query(f"WITH {_TOP}, a AS (SELECT u, count(DISTINCT i) AS n FROM raw GROUP BY u), h AS (SELECT u, rank, row_number() OVER (PARTITION BY u ORDER BY rank) AS hits FROM (SELECT DISTINCT u, i FROM raw) JOIN top USING (i)), s AS (SELECT u, sum(hits / rank::DOUBLE) AS s FROM h GROUP BY u) SELECT round(avg(coalesce(s, 0) / least(n, 500)), 9) AS map FROM a LEFT JOIN s USING (u)")
def map_at_k(spark, d):
    e = raw_edges(spark, d)
    truth = B.baskets(e)
    top = recommend.top_popular(e, 500).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("support")).alias("s"), "item"))), lambda x: x["item"]).alias("items"))
    return evaluate.mean_ap(truth, truth.select("user").crossJoin(F.broadcast(top)), 500).select(F.round("map", 9).alias("map"))


@query(f"WITH {_E}, test AS (SELECT u, i FROM e WHERE (u * 31 + i * 17) % 10 >= 7), train AS (SELECT u, i FROM e WHERE (u * 31 + i * 17) % 10 < 7), pop AS (SELECT i, row_number() OVER (ORDER BY count(*) DESC, i) AS r FROM train GROUP BY i), us AS (SELECT DISTINCT u FROM train), un AS (SELECT us.u, pop.i, row_number() OVER (PARTITION BY us.u ORDER BY r) AS rank FROM us CROSS JOIN pop LEFT JOIN train t ON t.u = us.u AND t.i = pop.i WHERE t.u IS NULL QUALIFY rank <= 10), w AS (SELECT u, count(*) AS wanted FROM test GROUP BY u), h AS (SELECT un.u, count(*) AS given, count(test.u) AS hits FROM un LEFT JOIN test USING (u, i) GROUP BY un.u), m AS (SELECT count(*) AS users, avg(CASE WHEN given > 0 THEN hits / given::DOUBLE END) AS p, avg(coalesce(hits, 0) / wanted::DOUBLE) AS r FROM w LEFT JOIN h USING (u)) SELECT users, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM m")
def precision_recall_at_10(spark, d):
    e = raw_edges(spark, d).distinct()
    part = (F.col("user") * 31 + F.col("item") * 17) % 10
    recs = recommend.popular_unseen(e.where(part < 7), 10)
    out = evaluate.precision_recall(recs, e.where(part >= 7), 10)
    return out.select("users", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query()
def als_implicit_topn(spark, d):
    r = written(ratings(spark, d), "ratings")
    return recommend.als_top(recommend.als(r, implicit=True), r, 500)


@query()
def als_explicit_topn(spark, d):
    r = written(ratings(spark, d), "ratings")
    return recommend.als_top(recommend.als(r), r, 500)


@query()
def als_rmse(spark, d):
    train, test = evaluate.hold_out(ratings(spark, d), 0.7, 0.5)
    return evaluate.errors(recommend.als(train).transform(test))


_HELD = f"{_RATED}, m AS (SELECT i, avg(x) AS p FROM r WHERE (u * 31 + i * 17) % 10 < 7 GROUP BY i), j AS (SELECT x, p, u, i FROM r JOIN m USING (i) WHERE (u * 31 + i * 17) % 10 >= 7)"


@query(f"WITH {_HELD} SELECT count(*) AS n, round(sqrt(avg((p - x) * (p - x))), 6) AS rmse, round(avg(abs(p - x)), 6) AS mae FROM j")
def prediction_errors(spark, d):
    """Errors of fixed predictions: each item's mean rating in the training part."""
    r, part = ratings(spark, d), (F.col("user") * 31 + F.col("item") * 17) % 10
    means = r.where(part < 7).groupBy("item").agg(F.avg("rating").alias("prediction"))
    return evaluate.errors(r.where(part >= 7).join(means, "item")).select("n", F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"))


# extension


@query("SELECT event_type, count(*) AS support FROM events GROUP BY event_type")
def streaming_support(spark, d):
    """The running support of a stream over events, after all of it."""
    from ..streaming import running_support

    name = f"support_{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    run = running_support(stream, "event_type").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


