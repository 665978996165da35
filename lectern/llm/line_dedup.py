"""Cross-site boilerplate lines by distinct-site spread, with built-in functions only.

HyperLogLog sketches of the sites, one per line hash, merge in the aggregation. Lines whose estimate
is near the threshold get exact distinct counts; the others are decided by the sketch.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import Stash, row_key, text_of

LG_K = 12


def _line_hashes(text: Column) -> Column:
    """The distinct hashes of the lines that hold a word."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def boilerplate_lines(docs: DataFrame, min_sites: int, site_col: str, text_col: str) -> DataFrame:
    """(line) hashes of the lines on at least ``min_sites`` distinct sites; null sites are not counted."""
    seen = docs.filter(F.col(site_col).isNotNull()).select(F.col(site_col).cast("string").alias("site"), F.explode(_line_hashes(text_of(text_col))).alias("line"))
    spread = seen.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"))
    # six standard errors and at least 2: in that band the exact count decides
    near = max(2, math.ceil(6 * 1.04 / math.sqrt(2**LG_K) * min_sites))
    spread = Stash(spread.filter(F.col("sites") >= min_sites - near), "spread").df
    sure = spread.filter(F.col("sites") > min_sites + near).select("line")
    unsure = spread.filter(F.col("sites") <= min_sites + near).select("line")
    # distinct before the join: at most one row per line and site is left of a hot line
    exact = seen.distinct().join(unsure, "line", "left_semi").groupBy("line").agg(F.count("*").alias("sites"))
    return sure.unionByName(exact.filter(F.col("sites") >= min_sites).select("line"))


def drop_spread_lines(docs: DataFrame, min_sites: int = 5, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with three more columns: kept_text, n_lines, n_removed.

    Removes every line (parted by \\n, with a word in it) that stands on ``min_sites`` or more distinct
    sites, wherever it stands, also in rows without a site. Blank lines stay. A null text is an empty
    one; repeated rows get the same result; columns of these names are replaced, others stay. An empty table
    gives an empty result. A text and its lines have to fit an executor's memory.
    """
    boilerplate = Stash(boilerplate_lines(docs, min_sites, site_col, text_col), "boilerplate").df
    # equal rows share what is to be removed from them; the id keeps copies of one text apart
    key = row_key(id_col, text_col)
    keyed = docs.withColumn("__key", key)
    hits = docs.select(key.alias("__key"), F.explode(_line_hashes(text_of(text_col))).alias("line"))
    hits = hits.join(boilerplate, "line", "left_semi").groupBy("__key").agg(F.collect_set("line").alias("__drop"))
    lines = F.split(text_of(text_col), "\n")
    kept = F.when(F.col("__drop").isNull(), lines).otherwise(F.filter(lines, lambda x: ~(F.array_contains("__drop", F.xxhash64(x)) & x.rlike(r"[^\x20\x09-\x0D]"))))
    out = keyed.join(hits, "__key", "left").withColumn("__kept", kept)
    out = out.withColumn("n_lines", F.size(lines).cast("long")).withColumn("n_removed", (F.size(lines) - F.size("__kept")).cast("long"))
    return out.withColumn("kept_text", F.array_join("__kept", "\n")).drop("__key", "__drop", "__kept")
