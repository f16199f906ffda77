"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
every one but the last returns the columns of documents. Stages read what the one
before wrote, so a lost executor repeats part of one stage.

* Null texts pass as empty ones until a stage rejects or changes them (the quality
  rules reject texts of fewer than ten words). Rows with null or equal ids, and repeated
  rows, are documents like others: of each group of similar rows one row stays. Ties go to
  the smaller id, then to the earlier row. Columns of documents that are missing are null,
  others are left out. Empty tables give empty tables.
* Every stage's docs must be a stored table, as ``run`` makes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duplexa.llm import ngram_join, packing, quality_rules, secret_scan, suffix_dedup
from duplexa.llm import _exchange as X
from duplexa.sources.staging import stage_path

KINDS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
COLUMNS = list(KINDS)


def documents(docs: DataFrame) -> DataFrame:
    """The columns of documents."""
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c) for c, kind in KINDS.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base or a learned rule rejects."""
    docs = documents(docs)
    rules = quality_rules.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.judge(docs, rules).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of similar ones, that with the smallest id (null ids last). Rows without words are groups of their own."""
    rows = X.written(documents(docs).withColumn("__row", F.monotonically_increasing_id()), "rows")  # numbered once and for all
    groups = ngram_join.join(rows, id_col="__row").select("__row", "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("first")
    kept = rows.select("__row", "doc_id").join(groups, "__row").groupBy("component_id").agg(first).select("first.__row")
    return rows.join(X.small(X.written(kept, "kept")), "__row", "left_semi").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes byte strings that occur earlier in the table; characters cut in two go as well. Documents stay, if need be as empty texts."""
    cut = suffix_dedup.remove_repeats(documents(docs), give=("kept_text",), keep_first=True, keep_text=False)
    return cut.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret that is found."""
    docs = documents(docs)
    found = secret_scan.scan(docs, secret_scan.learn(docs))
    changed = F.col("spans") != ""
    return found.withColumn("text", F.when(changed, F.col("redacted")).otherwise(F.col("text"))).withColumn("n_chars", F.when(changed, F.length("redacted")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences."""
    return packing.pack(documents(docs), keep=False)


STAGES = [("quality_rules", quality), ("ngram_join", near_duplicates), ("suffix_dedup", repeats), ("secret_scan", secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = stage_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs


#: SQL cannot express the learned rules, the network or the packing.
ORACLE_SQL = None


def queries() -> dict:
    return {"pipeline": run}
