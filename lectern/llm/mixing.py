"""Mixing sources to target weights in whole blocks.

The texts of a source, laid end to end in a fixed pseudorandom order, are cut into blocks of a fixed
number of words; a source's quota is the number of blocks that its target asks. The output is a number
of shards of as many slots each. For one shard after the other, a multinomial draw says how many of its
slots each source gets, with probabilities in proportion to what is left of the quotas: so the draws
decide the mix, and what one shard has too much of a source the next ones tend to have less of. A source's slots,
numbered through all shards, map to its blocks by a keyed permutation of the block indices, a new one for
each time round; slots and blocks join by index.

Sources are drawn in two steps: the driver draws how many slots each group of sources gets, each group
deals its own out to its sources. That is the same distribution, and the driver holds groups alone.

Tables with a row for each document or block join by sorted shuffle, by hint: they are rows of small numbers that
Parquet packs into a byte or two, so by the size of their files they would be broadcast at fifty times that.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import WORD, Stash, n_words, text_of
from lectern.llm.textbytes import U64, mix

WEIGHTS = (5, 2, 1)
#: Up to so many sources are ranked by the driver and broadcast; more stay a table.
MAX_SOURCES = 1_000_000
#: Sources of a group, which is drawn for as a whole first.
GROUP = 1024
RUN = 4096
#: Words in a block; the last block of a source has what is left.
BLOCK = 128
SHARDS = 256
#: Quotas are whole numbers of this part of a slot, so that sums don't depend on their order.
PART = 1 << 20
STEPS = np.arange(4, dtype=U64) * U64(0x9E3779B97F4A7C15)
#: Rows of a lane of a source, and slots of a task.
LANE_ROWS, TASK_SLOTS = 50_000, 1_000_000


def targets(sizes: list[int], total_share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> list[float]:
    """Words to take of each source: ``total_share`` of all, by weight, none above ``cap`` times its size."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, left, free = [0.0] * len(sizes), total_share * sum(sizes), list(range(len(sizes)))
    while free:
        unit = left / sum(weight[i] for i in free)
        full = [i for i in free if unit * weight[i] > cap * sizes[i]]
        if not full:
            for i in free:
                out[i] = unit * weight[i]
            break
        for i in full:
            out[i] = cap * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """index[i] (below n[i]) under a pseudorandom permutation of range(n[i]) chosen by key[i].

    A four-round Feistel network on the next even number of bits, walked on while it is outside.
    """
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.int64).astype(U64)
    low = (U64(1) << half) - U64(1)
    x, todo = index.astype(U64), np.arange(len(index))
    while len(todo):
        a, b, k, m, h = x[todo] >> half[todo], x[todo] & low[todo], key[todo], low[todo], half[todo]
        for r in range(4):
            a, b = b, a ^ (mix(b + k + STEPS[r]) & m)
        x[todo] = (a << h) | b
        todo = todo[x[todo] >= n[todo].astype(U64)]
    return x.astype(np.int64)


def draw_counts(slots: np.ndarray, quota: np.ndarray, most: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """How many of the slots of each shard each source gets: (shards, sources).

    A multinomial draw for each shard, in proportion to what is left of the quotas (in PARTs of a slot); none
    gets more than ``most`` in all, what is beyond it being drawn again among the others.
    """
    out, got = np.zeros((len(slots), len(quota)), np.int64), np.zeros(len(quota), np.int64)
    for i, n in enumerate(slots):
        left = int(min(n, (most - got).sum()))
        while left:
            open_ = most > got
            p = np.where(open_, np.maximum(quota / PART - got, 0.0), 0.0)
            p = p if p.sum() > 0 else np.where(open_, most - got, 0).astype(float)
            more = np.minimum(rng.multinomial(left, p / p.sum()), most - got)
            out[i] += more
            got += more
            left -= int(more.sum())
    return out


def shard_slots(quota: int, shards: int) -> np.ndarray:
    """The slots of each shard: as many as all quotas ask, dealt evenly."""
    return np.diff([round(quota * i / shards / PART) for i in range(shards + 1)])


def _deal(seed: int):
    """The slots of each source of a group by output shard, numbered through."""

    def run(key, table):
        sid, quota, most = (table[c].to_numpy() for c in ("sid", "quota", "most"))
        order = np.argsort(sid)
        sid = sid[order]
        slots = np.array(table["given"][0].as_py(), np.int64)
        counts = draw_counts(slots, quota[order], most[order], np.random.default_rng([seed, 1, key[0].as_py()]))
        first = np.cumsum(counts, axis=0) - counts
        shard, i = np.nonzero(counts)
        return pa.table({"sid": pa.array(sid[i]), "shard": pa.array(shard.astype(np.int32)), "first": pa.array(first[shard, i]), "n": pa.array(counts[shard, i])})

    return run


def _draw(seed: int):
    """The block of each slot."""

    def run(batches):
        for batch in batches:
            sid, shard, slot, salt, blocks = batch.columns
            s, n = slot.to_numpy(), blocks.to_numpy()
            key = mix(mix(salt.to_numpy().astype(U64) + U64(seed)) + (s // n).astype(U64))
            yield pa.RecordBatch.from_arrays([sid, shard, pa.array(permuted(s % n, n, key))], ["sid", "shard", "block"])

    return run


def _figures(sid: list[int], names: list[str | None], sizes: list[int], goal: list[float], cap: float, seed: int) -> list[tuple]:
    """What each source has and asks: quota and most are in PARTs of a slot and in slots."""
    size, target = np.array(sizes, np.int64), np.array(goal, np.float64)
    salt = np.array([zlib.crc32(b"\0" if name is None else b"s" + name.encode()) for name in names], np.int64)
    blocks = -(-size // BLOCK)
    most = np.floor(cap * blocks).astype(np.int64)
    quota = np.minimum(np.rint(target / np.maximum(size, 1) * blocks * PART).astype(np.int64), most * PART)
    return list(zip(sid, names, sizes, goal, *(x.tolist() for x in (blocks, quota, most, salt)), strict=True))


SOURCES = "sid long, source string, source_size long, target double, blocks long, quota long, most long, salt long"


def _ranked(found: DataFrame) -> DataFrame:
    """sid, source, size: the rank of each source by range partitions, of which the driver holds the counts."""
    order = F.col("source").asc_nulls_last()
    parts = Stash(found.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "ranges").df
    counts = sorted(parts.groupBy("part").count().collect())
    before, n = [], 0
    for part, rows in counts:
        before.append((part, n))
        n += rows
    before = F.broadcast(parts.sparkSession.createDataFrame(before, "part int, before long"))  # a row for each partition
    within = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return parts.withColumn("at", within).join(before, "part").select((F.col("before") + F.col("at")).alias("sid"), "source", "size")


def _many_sources(found: DataFrame, total_share: float, cap: float, seed: int) -> DataFrame:
    """As ``_sources``, of any number of sources: ``targets`` as sums over the table of sources."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    ranked = Stash(_ranked(found).withColumn("weight", weight), "sources").df
    most = F.col("size") * float(cap)
    unit, full, seen = 0.0, F.lit(False), -1
    while True:
        zero = F.lit(0.0)
        total, capped, free, n = ranked.agg(F.sum("size"), F.sum(F.when(full, most).otherwise(zero)), F.sum(F.when(full, zero).otherwise(F.col("weight"))), F.count_if(full)).first()
        if n == seen or not free:
            break
        unit, seen = (total_share * total - capped) / free, n
        full = F.col("weight") * F.lit(unit) > most
    target = F.when(full, most).otherwise(F.col("weight") * F.lit(unit))

    def run(batches):
        for batch in batches:
            rows = _figures(*(c.to_pylist() for c in batch.columns), cap, seed)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.float64(), *[pa.int64()] * 4))], names=[x.split()[0] for x in SOURCES.split(", ")])

    return Stash(ranked.select("sid", "source", "size", target.alias("target")).mapInArrow(run, SOURCES), "figures").df.hint("merge")


def _sources(rows: DataFrame, total_share: float, cap: float, seed: int) -> DataFrame:
    """sid, source, source_size, target, blocks, quota, most, salt of each source."""
    table = Stash(rows.groupBy("source").agg(F.sum("size").alias("size")), "sizes").df
    found = table.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        return _many_sources(table, total_share, cap, seed)
    found = sorted(found, key=lambda r: (r[0] is None, r[0] or ""))
    goal = targets([r[1] for r in found], total_share, cap)
    made = _figures(list(range(len(found))), [r[0] for r in found], [r[1] for r in found], goal, cap, seed)
    return F.broadcast(rows.sparkSession.createDataFrame(made, SOURCES))  # at most MAX_SOURCES rows


def _dealt(sources: DataFrame, shards: int, seed: int) -> tuple[DataFrame, int]:
    """((sid, shard, first, n) of the slots of each source in each shard, number of slots)."""
    grouped = sources.select("sid", "quota", "most").withColumn("group", F.floor(F.col("sid") / GROUP))
    sums = sorted(tuple(r) for r in grouped.groupBy("group").agg(F.sum("quota"), F.sum("most")).collect())  # a row for GROUP sources
    quota, most = np.array([r[1] for r in sums], np.int64), np.array([r[2] for r in sums], np.int64)
    slots = shard_slots(int(quota.sum()), shards)
    counts = draw_counts(slots, quota, most, np.random.default_rng([seed, 0])) if len(sums) else np.zeros((shards, 0), np.int64)
    given = sources.sparkSession.createDataFrame([(r[0], counts[:, i].tolist()) for i, r in enumerate(sums)], "group long, given array<long>")
    dealt = grouped.join(given, "group").groupBy("group").applyInArrow(_deal(seed), "sid long, shard int, first long, n long")
    return Stash(dealt, "dealt").df, int(counts.sum())


def mix_plan(rows: DataFrame, total_share: float = 1.5, cap: float = 2.0, shards: int = SHARDS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The mix of ``rows`` (rid unique, id, source, size in words): (rows with their source's figures, parts).

    parts: (rid, lo, hi, shards): the words lo to hi of row rid stand in one block, and go to these output
    shards, once for each time that the block is drawn (up to ``cap`` times, a whole number); what isn't drawn has no part.
    """
    sources = _sources(rows, total_share, cap, seed)
    lanes = max(SHARDS, rows.count() // LANE_ROWS)
    placed = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    placed = placed.withColumn("lane", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(lanes)).cast("int"))
    lane = placed.groupBy("sid", "lane").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("sid").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1))
    lane = lane.select("sid", "lane", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.sum("size").over(Window.partitionBy("sid", "lane").orderBy("id", "rid").rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("upto", within).join(lane.hint("merge"), ["sid", "lane"])
    placed = Stash(placed.withColumn("start", F.col("before") + F.col("upto") - F.col("size")).drop("upto", "before", "lane"), "placed").df

    dealt, n_slots = _dealt(sources, shards, seed)
    runs = dealt.select("sid", "shard", (F.col("first") + F.col("n")).alias("end"), F.explode(F.sequence("first", F.col("first") + F.col("n") - 1, F.lit(RUN).cast("long"))).alias("at"))
    n_tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_slots // TASK_SLOTS)
    runs = runs.join(sources.select("sid", "salt", "blocks"), "sid").repartition(n_tasks, "sid", "at")
    slots = runs.select("sid", "shard", F.explode(F.sequence("at", F.least(F.col("at") + RUN, "end") - 1)).alias("slot"), "salt", "blocks")
    drawn = slots.mapInArrow(_draw(seed), "sid long, shard int, block long")
    drawn = drawn.groupBy("sid", "block").agg(F.array_sort(F.collect_list("shard")).alias("shards"))  # at most ``cap``

    spread = placed.filter("size > 0").select(
        "rid", "sid", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK))).alias("block")
    )
    at = F.col("block") * BLOCK
    parts = spread.join(drawn.hint("merge"), ["sid", "block"]).select(
        "rid", (F.greatest(at, "start") - F.col("start")).alias("lo"), (F.least(at + BLOCK, F.col("start") + F.col("size")) - F.col("start")).alias("hi"), "shards"
    )
    return placed, parts


def _rows(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(text_of(text_col)).alias("size"))


def mix_taken(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken (words the mix takes, repeats counted), shards (where they go).

    Null and empty texts have no words. Sources go by code point, the null source last. Repeated rows are
    rows of their own; an empty table gives an empty result. The draw depends on the seed, the sources' names
    and sizes and the ids alone. Texts of any length are only counted here. Other columns, whatever their names, are ignored.
    """
    rows = Stash(_rows(docs, id_col, source_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "rows").df
    placed, parts = mix_plan(rows, **options)
    shards = F.array_sort(F.array_distinct(F.flatten(F.collect_list("shards"))))
    taken = parts.groupBy("rid").agg(F.sum((F.col("hi") - F.col("lo")) * F.size("shards")).alias("taken"), shards.alias("shards"))
    out = placed.join(taken.hint("merge"), "rid", "left")
    none = F.array().cast("array<int>")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", none).alias("shards"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: a row for each time that words of a document are taken.

    A document taken whole keeps its text as it is; of one taken in part, the taken words stay, joined
    by spaces. Documents of which nothing is taken are left out, so null, empty and wordless texts are. ``n_chars``,
    if there is one, follows. A text and its words have to fit an executor's memory. An empty table gives an empty result.
    """
    whole = Stash(docs.withColumn("__rid", F.monotonically_increasing_id()), "whole").df
    rows = whole.select("__rid", F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(text_of(text_col)).alias("size"))
    rows = Stash(rows.withColumnRenamed("__rid", "rid"), "rows").df
    placed, parts = mix_plan(rows, **options)
    parts = parts.withColumn("times", F.size("shards").cast("long"))
    part = F.struct(F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"), F.col("times"))
    taken = parts.groupBy("rid").agg(F.array_sort(F.collect_list(part)).alias("__parts"), F.max("times").alias("__most")).withColumnRenamed("rid", "__rid")
    taken = Stash(taken.join(placed.select(F.col("rid").alias("__rid"), F.col("size").alias("__size")).hint("merge"), "__rid"), "taken").df
    out = whole.join(taken.hint("merge"), "__rid").withColumn("__nth", F.explode(F.sequence(F.lit(1).cast("long"), "__most")))

    def text(parts: Column) -> Column:
        kept = F.filter(parts, lambda p: p["times"] >= F.col("__nth"))
        n = F.aggregate(kept, F.lit(0), lambda n, p: n + p["hi"] - p["lo"])
        words = F.array(F.regexp_extract_all(text_of(text_col), F.lit(WORD), F.lit(0)))  # cut once for all parts
        some = F.flatten(F.flatten(F.transform(words, lambda w: F.transform(kept, lambda p: F.slice(w, p["lo"] + 1, p["hi"] - p["lo"])))))
        return F.when(n == F.col("__size"), F.col(text_col)).otherwise(F.array_join(some, " "))

    out = out.withColumn(text_col, text(F.col("__parts")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
