"""Top-k hit rate of a search over cases with an expected section or principle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.index import Index
from lectern.operators.passages import holding
from lectern.operators.search import search_batch, small

CASES = "case_id long, query string, expect_principle string, expect_section string"


def holders(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs.*, passages.* of every document (doc_id, text) that holds a passage (case_id, query) as it stands."""
    pairs = holding(docs.select(F.col("doc_id").alias("id"), "text"), passages.select("case_id", "query")).withColumnRenamed("id", "doc_id")
    return docs.join(small(pairs, pairs), "doc_id").join(small(passages, passages), "case_id").select(*docs.columns, *passages.columns)


def case_hits(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, hit): whether any hit of the case has the expected section or principle; unset ones never match."""
    wanted = cases.select("case_id", *(F.nullif(F.col(c), F.lit("")).alias(c) for c in ("expect_section", "expect_principle")))
    match = F.coalesce(F.col("section") == F.col("expect_section"), F.lit(False)) | F.coalesce(F.col("principle") == F.col("expect_principle"), F.lit(False))
    found = hits.select("case_id", "section", "principle").join(wanted, "case_id").filter(match).select("case_id").distinct()
    return cases.select("case_id").join(found.withColumn("hit", F.lit(True)), "case_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def hit_rate(case_hit: DataFrame) -> DataFrame:
    """One row: hit_rate (0 without cases), n."""
    return case_hit.agg(F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("hit_rate"), F.count("*").alias("n"))


def score_cases(index: Index, units: DataFrame, cases: DataFrame, k: int = 5, weights: Sequence[float] = (1.0,)) -> DataFrame:
    """Hit rate of all cases in one plan."""
    hits = search_batch(index, units, cases.select("case_id", "query"), k, weights)
    return hit_rate(case_hits(hits, cases))
