"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
``documents``. Stages are written as Parquet and read again before the next one starts. Null texts count as
empty ones, null ids as ids like any other; every stage takes texts of any length whole and gives an empty
result for an empty table. Columns beyond those of ``documents`` go through the stages unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.decontaminate import contamination
from lectern.llm.mixing import mix_documents
from lectern.llm.near_dups import near_duplicates
from lectern.llm.quality_lines import keep_quality
from lectern.llm.sharding import minimax_shards
from lectern.llm.shared import Stash, row_key, without


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the fixed rules and the line labels keep. Null and empty texts fail the rules; repeated rows share their verdict."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one of least id (then least key); of equal rows, one. Texts without words are classes of their own."""
    named = docs.select(F.struct("doc_id", row_key().alias("key")).alias("row"), "text")
    classes = Stash(near_duplicates(named, id_col="row").select("row.key", F.col("class_id.key").alias("kept"), "class_rows"), "classes").df
    gone = classes.filter("key <> kept").select("key")
    again = Stash(classes.filter("key = kept and class_rows > 1").groupBy("key").count().filter("count > 1").select("key"), "again").df
    out = without(docs, gone, row_key())
    if again.limit(1).count():  # equal rows, which no key tells apart
        more = docs.withColumn("__key", row_key()).join(again.withColumnRenamed("key", "__key"), "__key", "left_semi").dropDuplicates(["__key"])
        out = without(out, again, row_key()).unionByName(more.drop("__key"))
    return out.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not contaminated by the benchmark; all of them if it has no items. Repeated rows share their verdict."""
    judged = contamination(docs.select("doc_id", "text", row_key().alias("row_key")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, judged.filter("contaminated").select(F.col("row_key").alias("key")), row_key()).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, a row for each time. Repeated rows are mixed each for itself; texts without words are left out."""
    return mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each mixed document: shard and slot. Equal texts go to one shard; repeated rows have slots of their own."""
    return minimax_shards(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: Stages 1, 2, 4 and 5 are beyond SQL; tests compare run() with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = Stash(stage(spark, docs, sf_dir), name).df
    return STAGES[-1][1](spark, docs, sf_dir)
