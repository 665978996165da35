"""How quality filters interact: what each removes in every order of applying them.

A document's failures are a mask, and all metrics depend on how many documents have a mask. So documents
are counted once by part, mask and labels; the counts are unpivoted against the steps of every order, and
a running bit-or over an order's steps tells what was removed before.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import Stash, salted, text_of
from lectern.llm.textbytes import CHUNK_BYTES, Hasher, Words, give_back, mix

#: The filters and their bits.
FILTERS = {"A": 1, "B": 2, "C": 4, "D": 8, "E": 16}
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, b"#$%&*|"


def _masks(words: Words) -> np.ndarray:
    """Failures of A to D of each row."""
    n = words.counts
    row = words.rows().astype(np.uint64)
    _, first = np.unique(mix(words.hashes + row * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    distinct = np.bincount(words.rows()[first], minlength=len(n))
    out = FILTERS["A"] * (n < MIN_WORDS) + FILTERS["B"] * (100 * distinct < MIN_DISTINCT_PERCENT * n)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    for i, (lo, hi) in enumerate(zip(words.offs, words.offs[1:], strict=False)):
        capitals = points = symbols = 0
        for at in range(lo, hi, CHUNK_BYTES):
            x = words.data[at : min(at + CHUNK_BYTES, hi)]
            capitals += np.count_nonzero((x >= 65) & (x <= 90))
            points += np.count_nonzero((x & 0xC0) != 0x80)
            symbols += np.count_nonzero(symbol[x])
        out[i] += FILTERS["C"] * (100 * capitals > MAX_CAPITAL_PERCENT * points) + FILTERS["D"] * (symbols > 0)
    return out


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part (the source, empty for null), mask of A to D, digest (SHA-256 of the text) of every row. Null texts are empty."""
    text = text_of()
    keyed = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, digest binary, mask int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            masks = [np.zeros(0, np.int64), *(_masks(words) for _, _, words in hasher.chunks(batch.column(3)))]
            yield pa.record_batch([*batch.columns[:3], pa.array(np.concatenate(masks), pa.int32())], ["doc_id", "part", "digest", "mask"])
        give_back()

    return keyed.mapInArrow(run, schema)


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: how many documents fail just the filters of the mask.

    E fails for a text that a smaller doc_id has too, in the whole table: texts are counted by digest, so that
    a text with very many copies is a row for each part and label before its least id is looked up. Null ids are
    neither smaller nor larger than others. A document is good (toxic) if any of its labels says so.
    """
    marks = Stash(failures(docs), "failures").df
    flags = labels.groupBy("doc_id").agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    # rows without an id have no labels and are dealt by their text
    keyed = marks.withColumns({"__none": F.col("doc_id").isNull(), "__by": F.coalesce(F.col("doc_id").cast("string"), F.hex("digest"))})
    flags = flags.filter("doc_id is not null").select(F.lit(False).alias("__none"), F.col("doc_id").cast("string").alias("__by"), "good", "toxic")
    known = keyed.join(flags, ["__none", "__by"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    kinds = ["digest", "part", "mask", "good", "toxic"]
    by_id = known.groupBy("__none", "__by", "doc_id", *kinds).agg(F.count("*").alias("n"))
    none = F.col("doc_id").isNull()
    by_text = by_id.groupBy(*kinds).agg(
        F.sum(F.when(none, 0).otherwise(F.col("n"))).alias("n"), F.sum(F.when(none, F.col("n")).otherwise(0)).alias("n_none"),
        F.min(F.when(~none, F.struct("doc_id", "n"))).alias("least"),
    )
    by_text = Stash(by_text, "texts").df
    shared = by_text.groupBy("digest").agg(F.count("*").alias("k"), F.min("least.doc_id").alias("first_id")).filter("k > 1").drop("k")
    first = salted(by_text, shared, ["digest"], "left")
    holds = F.col("least").isNotNull() & (F.coalesce("first_id", F.col("least.doc_id")) == F.col("least.doc_id"))
    passed = F.when(holds, F.col("least.n")).otherwise(0)
    split = first.select("part", "mask", "good", "toxic", F.explode(F.array(
        F.struct(F.lit(0).alias("e"), (passed + F.col("n_none")).alias("n")), F.struct(F.lit(FILTERS["E"]).alias("e"), (F.col("n") - passed).alias("n")),
    )).alias("x"))
    return split.filter("x.n > 0").groupBy("part", (F.col("mask") + F.col("x.e")).alias("mask"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def audit_orders(cells: DataFrame) -> DataFrame:
    """A row for each part, order and step of ``failure_cells``: filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = cells.sparkSession
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    bits = F.create_map(*(F.lit(x) for pair in FILTERS.items() for x in pair))
    spread = cells.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part", "mask", "good", "toxic")  # the window keeps this dealing
    steps = spread.withColumn("filter_order", F.explode(orders)).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "filter"))
    steps = steps.withColumn("bit", bits[F.col("filter")]).withColumn("failed", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "good", "toxic", "filter_order").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("failed").over(before), F.lit(0)))
    fails, here = F.col("failed") > 0, F.col("earlier") == 0

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    sums = steps.groupBy("part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), "filter").agg(
        total(~fails & here).alias("kept"), total(fails & here).alias("removed"), total(fails & ~here).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & here & F.col("good")).alias("good_lost"), total(fails & here & F.col("toxic")).alias("toxic_lost"),
    )
    return sums.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interaction of five filters over ``docs`` (doc_id, source, text), by source, with ``labels`` (doc_id, quality, toxic).

    A: under 50 words; B: under 65 % distinct words; C: over 5 % capital letters A-Z; D: any of ``#$%&*|``; E: a
    text of a smaller doc_id. Null and empty texts fail A alone (and E); repeated rows count each for itself and don't
    fail E for one another; an empty table gives an empty result; other columns are ignored. Distinct words
    are told apart by 64-bit hashes. A text is read by slices; its words' hashes have to fit a task's memory.
    """
    return audit_orders(Stash(failure_cells(docs, labels), "cells").df)
