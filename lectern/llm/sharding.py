"""Minimax contiguous partition of atomic groups of equal texts into shards of near equal bytes.

Groups are ordered by the MD5 of their text. The driver never sees the groups: it holds sums of bins
of that order and refines only the bins in which some cut may fall, until every such bin is one
group. On these it binary-searches the least feasible shard capacity, checked greedily, and cuts.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import Stash, text_of

FIRST_DIGITS = 4
MAX_FETCH = 200_000


@dataclass(frozen=True)
class Bin:
    """Groups whose key starts with ``prefix``: their bytes, their number."""

    prefix: str
    size: int
    groups: int


def _greedy(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """How many items lie before each cut if every shard takes all that fits; None if it needs more shards."""
    cuts, at, base = [], 0, 0
    for _ in range(shards):
        at = bisect_right(ends, base + capacity)
        if at == len(ends):
            return cuts
        base = ends[at - 1] if at else 0
        if cuts and cuts[-1] == at or not at:
            return None
        cuts.append(at)
    return None


def least_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity with which ``shards`` contiguous shards hold all items, whole and in order."""
    ends = list(accumulate(sizes))
    if not ends:
        return 0
    lo, hi = max(max(sizes), -(-ends[-1] // shards)), ends[-1]
    while lo < hi:
        mid = (lo + hi) // 2
        if _greedy(ends, mid, shards) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo


def even_cuts(sizes: list[int], shards: int) -> list[int]:
    """Cuts of least capacity; among those, each as near to its even place as the capacity allows."""
    ends = [0, *accumulate(sizes)]
    total, capacity = ends[-1], least_capacity(sizes, shards)
    earliest = [len(sizes)]  # from the back: the first item that the last shards can still hold
    for _ in range(shards - 1):
        earliest.append(bisect_right([-x for x in reversed(ends)], capacity - ends[earliest[-1]]))
        earliest[-1] = len(ends) - earliest[-1]
    earliest.reverse()
    cuts, at = [], 0
    for j in range(1, shards):
        latest = bisect_right(ends, ends[at] + capacity) - 1
        even = bisect_right(ends, total * j // shards) - 1
        if even < len(sizes) and ends[even + 1] * shards - total * j < total * j - ends[even] * shards:
            even += 1
        at = max(at, earliest[j - 1], min(even, latest))
        cuts.append(at)
    return cuts


def _at_risk(bins: list[Bin], shards: int) -> list[Bin]:
    """Bins of more than one group in which a cut of some capacity from the lower to the upper bound may fall."""
    ends = list(accumulate(b.size for b in bins))
    total = ends[-1]
    low, high = -(-total // shards), least_capacity([b.size for b in bins], shards)
    spans, lo = [], 0
    for j in range(1, shards):
        i = bisect_right(ends, lo + low)
        lo = max(lo, ends[i - 1] if i else 0)
        spans.append((min(lo, total - (shards - j) * high), min(j * high, total)))
    risk, start = [], 0
    for b, end in zip(bins, ends, strict=True):
        if b.groups > 1 and any(start <= t and end >= s for s, t in spans):
            risk.append(b)
        start = end
    return risk


def _bins(groups: DataFrame, digits: int) -> list[Bin]:
    prefix = F.substring("key", 1, digits)
    found = groups.groupBy(prefix.alias("p")).agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    return [Bin(*row) for row in found.collect()]


def shard_starts(groups: DataFrame, shards: int) -> list[str]:
    """The key prefix at which each shard after the first begins ('~', after all keys, for an empty shard)."""
    digits = FIRST_DIGITS
    bins = sorted(_bins(groups, digits), key=lambda b: b.prefix)
    if not bins:
        return ["~"] * (shards - 1)
    while risk := _at_risk(bins, shards):
        # so many more digits as keep the number of new bins bounded; 32 are the whole key
        digits = 32 if sum(b.groups for b in risk) <= MAX_FETCH or digits >= 28 else digits + (2 if len(risk) * 256 <= MAX_FETCH else 1)
        names = {b.prefix for b in risk}
        by_length: dict[int, list[str]] = {}
        for name in names:
            by_length.setdefault(len(name), []).append(name)
        within = F.lit(False)
        for length, some in by_length.items():
            within |= F.substring("key", 1, length).isin(some)
        bins = sorted([b for b in bins if b.prefix not in names] + _bins(groups.filter(within), digits), key=lambda b: b.prefix)
    cuts = even_cuts([b.size for b in bins], shards)
    return [bins[c].prefix if c < len(bins) else "~" for c in cuts]


def shard_of(key: Column, starts: list[str]) -> Column:
    return sum((F.when(key >= s, 1).otherwise(0) for s in starts), F.lit(0)).cast("int")


def minimax_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", lanes: int = 256) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: shards of near equal size, rows of equal text in one shard. If one group is larger
    than an even shard, that shard is as large as the group. Size is the text's UTF-8 bytes plus 8;
    null counts as the empty text, and both are one group. Slots are gapless from 0 in each shard,
    in the order of ``lanes`` lanes by a hash of the id (so that no task numbers a whole shard),
    then of text and id. Repeated rows get slots of their own. Shards may be empty if there are
    fewer groups than shards; an empty table gives an empty result. grown_shard is null: growth moves the
    cuts of this law. Texts of any length are only measured and hashed, never shuffled. Other columns, whatever
    their names, are ignored.
    """
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("key")
    )
    rows = Stash(rows, "sized").df
    starts = shard_starts(rows.groupBy("key").agg(F.sum("size").alias("size")), shards)
    rows = rows.withColumn("shard", shard_of(F.col("key"), starts)).withColumn("lane", F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int"))
    # at most shards x lanes rows
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy("shard", "lane").agg(F.count("*").alias("n")).select("shard", "lane", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "lane").orderBy("key", "id"))
    placed = rows.withColumn("nth", within).join(F.broadcast(offsets), ["shard", "lane"])
    return placed.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
