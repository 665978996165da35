"""Connected components of an edge table by alternating large-star and small-star steps.

Only aggregates and joins on node keys: no node's neighbours are gathered in one place, and the
driver sees two numbers a round. A hot node is the hot key of a plain equi-join, which adaptive
execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import Stash


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); the label is the least node of its component.

    Loops, repeated and reversed edges are allowed; an empty table gives an empty result.
    """
    stash = Stash(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(stash.df)
    for _ in range(max_rounds):
        if not state[0]:
            break
        after = Stash(_small_star(_large_star(stash.df).distinct()).distinct(), "edges")
        stash.drop()
        stash, before, state = after, state, _state(after.df)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    tied = stash.df.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return tied.unionByName(tied.select(F.col("label").alias("node"), "label").distinct())
