"""Substring search by character trigrams: the rarest ones of a passage find its candidates, whole texts decide.

A gram is one to three code points, packed into 63 bits, so grams are equal only if their characters are. The grams
of one and two characters, and the empty one, make passages that short a single look-up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.sources.scratch import scratch, spread

GRAMS = "gram long, id long"
#: Code point of no character, in grams of fewer than three.
NONE = (1 << 21) - 1
#: Grams of a passage that candidates have to have: its rarest ones.
RAREST = 4
#: Grams and candidates are broadcast up to so many rows, else joined by shuffle.
BROADCAST_ROWS = 500_000


def grams_of(text: str, exact: bool = False) -> np.ndarray:
    """The distinct grams of a text, up to three characters long; ``exact``: those that a text with this one in it must have."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    n = len(points)
    wide = [points, *(np.full(n, NONE) for _ in range(2))]
    of = {0: np.array([(NONE << 42) | (NONE << 21) | NONE], np.int64)}
    for width in (1, 2, 3):
        if n >= width:
            a, b, c = (points[i : n - width + 1 + i] if i < width else wide[1][: n - width + 1] for i in range(3))
            of[width] = np.unique((a << 42) | (b << 21) | c)
    return of[min(n, 3)] if exact else np.concatenate(list(of.values()))


def _cut(rows: DataFrame, key: str, column: str, exact: bool) -> DataFrame:
    """(gram, key) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for i in range(len(keys)):
                text = texts[i].as_py()
                if text is not None:
                    grams = grams_of(text, exact)
                    yield pa.record_batch([pa.array(grams), pa.array(np.zeros(len(grams), np.int64) + keys[i].as_py())], ["gram", key])

    return rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("long"), F.col(column)).mapInArrow(run, f"gram long, {key} long")


@dataclass
class TrigramIndex:
    """Which units have a gram."""

    postings: DataFrame  # gram, id

    def save(self, path: str) -> None:
        """In order of gram, so that a passage's grams prune files and row groups."""
        self.postings.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TrigramIndex:
        return cls(spark.read.schema(GRAMS).parquet(path))


def build_trigrams(units: DataFrame) -> TrigramIndex:
    """The index of ``units`` (id, text), ids being distinct integers. Null texts have no grams. Texts are cut once; only numbers are written."""
    return TrigramIndex(scratch(_cut(spread(units.select("id", "text")), "id", "text", False), "grams"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def candidates(index: TrigramIndex, passages: DataFrame) -> DataFrame:
    """(case_id, id) of the units that have the rarest grams of a passage (case_id, query), all of them.

    Documents that a gram has are counted for the grams of passages alone, and only those of the rarest are read again.
    """
    needed = scratch(_cut(passages, "case_id", "query", True), "needed")
    grams = needed.select("gram").distinct()
    df = scratch(index.postings.join(_small(grams), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df")), "dfs")
    nth = F.row_number().over(Window.partitionBy("case_id").orderBy("df", "gram"))
    known = needed.join(_small(df), "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = scratch(known.withColumn("nth", nth).filter(F.col("nth") <= RAREST).select("case_id", "gram", F.max("nth").over(Window.partitionBy("case_id")).alias("asked")), "rarest")
    found = index.postings.join(_small(rarest), "gram").groupBy("case_id", "id", "asked").agg(F.count("*").alias("n"))
    return found.filter(F.col("n") == F.col("asked")).select("case_id", "id")


def containing(index: TrigramIndex, units: DataFrame, passages: DataFrame) -> DataFrame:
    """units.*, passages.* of every unit (id, text) that holds a passage (case_id, query) as it stands.

    Ids and case_ids are distinct. No text takes part before its unit is a candidate, and then once for each passage. An
    empty passage is held by every text; a null one by none.
    """
    pairs = scratch(candidates(index, passages), "pairs")
    theirs = _small(pairs)
    both = units.join(theirs, "id").join(_small(passages), "case_id")
    return both.filter(F.col("text").contains(F.col("query"))).select(*units.columns, *passages.columns)
