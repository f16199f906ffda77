"""Readers and writers, every reader with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import alphabet_position, sub_string, to_long

TRIPLE = "user BIGINT, item BIGINT, cnt INT"
STRING_EDGE = "user STRING, item STRING"


def triples(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """user, item, cnt from separated text; cells that are no numbers are null."""
    return spark.read.schema(TRIPLE).option("sep", sep).csv(path)


def edges(spark: SparkSession, path: str, sep: str = "\t", user_space: bool = False) -> DataFrame:
    """(user, item) of triples, the sides swapped for ``user_space``; rows without a user or an item go."""
    df = triples(spark, path, sep).select("user", "item").na.drop()
    return df.select(F.col("item").alias("user"), F.col("user").alias("item")) if user_space else df


def parsed_triples(lines: DataFrame, column: str = "value", sep: str = "\t") -> DataFrame:
    """Edges of raw lines; lines whose item is empty go."""
    parts = F.split(column, sep)
    rows = lines.select(parts[0].alias("user"), parts[1].alias("item")).where("item is not null and item <> ''")
    return rows.select(to_long("user").alias("user"), F.col("item"))


def string_edges(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return spark.read.schema(STRING_EDGE).option("sep", sep).csv(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def fixed_width(rows: DataFrame, column: str = "value", user: tuple[int, int] = (0, 20), item: tuple[int, int] = (29, 44)) -> DataFrame:
    """Distinct trimmed (user, item) of character ranges, ends exclusive."""
    return rows.select(F.trim(sub_string(column, *user)).alias("user"), F.trim(sub_string(column, *item)).alias("item")).distinct()


def external_table(spark: SparkSession, name: str, path: str, schema: str = TRIPLE, sep: str = "\t") -> DataFrame:
    """A table over delimited files where they lie."""
    return spark.catalog.createTable(name, path=path, source="csv", schema=T.StructType.fromDDL(schema), sep=sep)


def preferences(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """user, item, rating; a missing rating is 1."""
    df = spark.read.schema("user BIGINT, item BIGINT, rating DOUBLE").option("sep", sep).csv(path)
    return df.select("user", "item", F.coalesce("rating", F.lit(1.0)).alias("rating")).na.drop()


def boolean_preferences(df: DataFrame) -> DataFrame:
    return df.select("user", "item").na.drop().distinct().withColumn("rating", F.lit(1.0))


def baskets(spark: SparkSession, path: str) -> DataFrame:
    """Parquet of (user, items array)."""
    return spark.read.schema("user BIGINT, items ARRAY<BIGINT>").parquet(path)


def comma_baskets(rows: DataFrame, user: str = "user", items: str = "items", alphabet: str | None = None) -> DataFrame:
    """Edges of comma-separated baskets, letters as their position in an alphabet if one is given."""
    out = rows.select(F.col(user).alias("user"), F.explode(F.split(items, ",")).alias("item"))
    return out if alphabet is None else out.withColumn("item", alphabet_position("item", alphabet))


def dictionary(rows: DataFrame, column: str = "value") -> DataFrame:
    """(key, val) of white-space separated lines."""
    parts = F.split(F.trim(F.col(column)), r"\s+")
    return rows.select(parts[0].alias("key"), parts[1].alias("val"))


def ordered_list(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value): the lines of files with their number, from 0, in the order of names and places; read in splits."""
    from ..operators.encode import ranked

    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")]
    rows = spark.read.text(path).select("value", *at)  # lines of a split are numbered in their order
    return ranked(rows, ["file", "block", "line"], "pos").select((F.col("pos") - 1).alias("pos"), "value")


def aligned_lists(spark: SparkSession, predicted: str, actual: str) -> DataFrame:
    """(user, predicted, actual): lists of two files, white space between items, matched by line; user is the line's number. Lists of bigint, null where a file has no such line."""
    lists = lambda path, name: ordered_list(spark, path).select(F.col("pos").alias("user"), F.transform(F.filter(F.split("value", r"\s+"), lambda x: x != ""), lambda x: x.try_cast("bigint")).alias(name))
    return lists(predicted, "predicted").join(lists(actual, "actual"), "user", "full_outer")


def stored_counts(spark: SparkSession, path: str, min_support: int, side: str = "item") -> DataFrame:
    """Frequent nodes of stored counts (Parquet of node and support); the threshold reaches the scan."""
    return spark.read.schema(f"{side} BIGINT, support BIGINT").parquet(path).where(F.col("support") >= min_support)


def recommendations(rows: DataFrame, column: str = "value") -> DataFrame:
    """(user, items) of "user<tab>i i" or "user<tab>[i:score,...]" lines."""
    parts = F.split(column, "\t")
    listed = F.filter(F.split(F.regexp_replace(parts[1], r"[\[\]]", ""), r"[,\s]+"), lambda x: x != "")
    return rows.select(to_long(parts[0]).alias("user"), F.transform(listed, lambda x: F.split(x, ":")[0].cast("bigint")).alias("items"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").csv(path)


def write_table(df: DataFrame, name: str, sep: str = "\t", path: str | None = None) -> DataFrame:
    """A table of delimited text made from a query, replaced if it is there; at ``path`` if given."""
    writer = df.write.mode("overwrite").format("csv").option("sep", sep)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def basket_text(df: DataFrame, with_user: bool = True) -> DataFrame:
    """One line for each basket: items by a space, the user before a tab if wanted."""
    items = F.array_join(F.transform("items", lambda x: x.cast("string")), " ")
    return df.select((F.concat_ws("\t", F.col("user").cast("string"), items) if with_user else items).alias("value"))


def link_text(adjacency: DataFrame) -> DataFrame:
    """Adjacency rows as "a<tab>b<tab>support" lines."""
    return adjacency.select("item", F.inline("adj")).select(F.concat_ws("\t", F.col("item").cast("string"), F.col("other").cast("string"), F.col("support").cast("string")).alias("value"))


def recommendation_text(df: DataFrame) -> DataFrame:
    """(user, items) as "user<tab>i i i" lines."""
    return df.select(F.concat_ws("\t", F.col("user").cast("string"), F.array_join(F.transform("items", lambda x: x.cast("string")), " ")).alias("value"))


def write_submission(df: DataFrame, users: DataFrame, path: str) -> None:
    """Item lists in the order of ``users`` (pos, user): files whose concatenation by name is the list. Users without a list get an empty line."""
    rows = users.join(df, "user", "left").select("pos", F.coalesce(F.array_join(F.transform("items", lambda x: x.cast("string")), " "), F.lit("")).alias("value"))
    rows.orderBy("pos").select("value").write.mode("overwrite").text(path)
