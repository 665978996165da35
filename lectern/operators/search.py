"""Prefix search ranked by column-weighted BM25, for a table of queries at once.

Every usable query token is a phrase of its own, repeats included. A phrase finds the rows with a term
that starts with it. Weights multiply counts before saturation; document frequencies, lengths and
their mean are those of the whole corpus, whatever facets are asked for.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.stem import stem_word, stems
from lectern.functions.text import MIN_QUERY_TOKEN, QUERY_TOKEN, query_tokens
from lectern.operators.index import LEAD, Index
from lectern.sources.scratch import scratch

# Fixed values of the ranking.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: A query of up to so many distinct prefixes is one filter on the postings.
MAX_IN_PLAN = 64
#: Prefixes and terms of queries are broadcast up to so many rows (some 50 MB), else joined by shuffle.
BROADCAST_ROWS = 500_000
#: Prefixes that share a lead at most, to be compared one by one with the terms that have it.
LEAD_PREFIXES = 256
#: Matching rows of all queries of a batch beyond which their k best are searched under bounds; below it all are summed sooner.
#: (Summed where they are, 34 million take 55 s and 233 MB of shuffle; under bounds, candidates meeting parts by query, 69 s and 660 MB.)
BOUND_FROM = 10_000_000_000
#: Postings that a task gathers by row, and parts that one adds up, at most, on average.
TASK_POSTINGS, TASK_PARTS = 2_000_000, 4_000_000
#: Rows, for each that is asked for, that a query's rarest prefixes bring to find its first threshold.
FIRST_ROWS = 100
#: Bounds count as reached this far below a threshold: sums in another order differ by less.
SLACK = 1e-6
#: Columns of a corpus and their weights.
UNIT_WEIGHTS = {"text": 10.0, "context_line": 4.0, "applies_when": 5.0, "key_terms": 8.0, "questions": 4.0}


def phrases_of(queries: DataFrame, stemmed: bool) -> DataFrame:
    """(case_id, pos, prefix) of every usable token of (case_id, query)."""
    tokens = queries.select("case_id", F.posexplode(query_tokens(F.col("query"))).alias("pos", "token"))
    if not stemmed:
        return tokens.select("case_id", "pos", F.lower("token").alias("prefix"))
    known = tokens.select("token").distinct().withColumn("prefix", stems(F.lower("token")))
    return tokens.join(known, "token").select("case_id", "pos", "prefix")


def expand(prefixes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(prefix, term, df) for every term that starts with a prefix (distinct ones of ``prefix``).

    A prefix is a range of the terms in order: blocks of its lead are found by an equi-join, those of its range by
    their fences, and only their terms are looked at. Prefixes shorter than a lead take all blocks whose lead starts so.
    """
    distinct = scratch(prefixes.select("prefix").distinct(), "prefixes")
    size = F.least(F.length("prefix"), F.lit(LEAD))
    found = None
    for n in sorted(r[0] for r in distinct.select(size.alias("n")).distinct().collect()):  # LEAD lengths at most
        some = distinct.filter(size == n).withColumn("key", F.substring("prefix", 1, n))
        keyed = blocks.withColumn("key", F.substring("lead", 1, n))
        here = keyed.join(small(some, some), "key").filter((F.substr("first", F.lit(1), F.length("prefix")) <= F.col("prefix")) & (F.col("last") >= F.col("prefix")))
        found = here.select("prefix", "terms") if found is None else found.unionByName(here.select("prefix", "terms"))
    if found is None:
        found = blocks.select(F.col("lead").alias("prefix"), "terms").limit(0)
    return found.select("prefix", F.explode("terms").alias("t")).select("prefix", "t.term", "t.df").filter(F.col("term").startswith(F.col("prefix")))


def idf(n_docs: Column, df: Column) -> Column:
    value = F.log((n_docs - df + 0.5) / (df + 0.5))
    return F.when(value <= 0, F.lit(IDF_FLOOR)).otherwise(value)


def small(df: DataFrame, rows: DataFrame) -> DataFrame:
    """``df``, to be broadcast if ``rows``, of which it has no more, are at most BROADCAST_ROWS."""
    return F.broadcast(df) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _by_id(rows: DataFrame, least: int) -> DataFrame:
    """``rows`` dealt out by id, in as many parts as a shuffle has and ``least`` ones at least, which stay apart."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), least), "id")


@dataclass
class Parts:
    """What rows add to the scores of queries, by prefix: how often each row has it, kept by row, and what that counts."""

    asked: DataFrame  # case_id, prefix (a number), times, df, idf: how often a query asks for a prefix, and how rare it is
    hits: DataFrame  # id, dl, prefixes, fs: the prefixes that a row has and their weighted counts, side by side
    avgdl: float

    def parts(self, hits: DataFrame) -> DataFrame:
        """(prefix, id, sat) of every prefix of every row; a prefix adds idf * sat to a query that asks for it once."""
        each = hits.select("id", "dl", F.inline(F.arrays_zip("prefixes", "fs"))).toDF("id", "dl", "prefix", "f")
        norm = K1 * (1 - B + B * F.col("dl") / F.lit(self.avgdl))
        return each.select("prefix", "id", (F.col("f") * (K1 + 1) / (F.col("f") + norm)).alias("sat"))

    @cached_property
    def postings(self) -> int:
        """Parts that all queries ask for."""
        return self.asked.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]

    def added(self) -> DataFrame:
        """(case_id, id, part) of all that is asked for. Only rows of hits are dealt out: what is summed by row then is where it is."""
        rows = self.parts(_by_id(self.hits, self.postings // TASK_PARTS + 1))
        return rows.join(small(self.asked, self.asked), "prefix").select("case_id", "id", (F.col("times") * F.col("idf") * F.col("sat")).alias("part"))


def matching(postings: DataFrame, prefixes: DataFrame, index: Index) -> DataFrame:
    """postings.*, code for each of ``prefixes`` (prefix, code) that a posting's term starts with.

    Prefixes that can be broadcast meet postings by the lead of the term, so no posting is shuffled. Where a lead has more
    than LEAD_PREFIXES of them, all starts of a term are looked up; more prefixes than that are expanded to terms first.
    """
    if prefixes.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        terms = scratch(expand(prefixes, index.blocks).select("prefix", "term"), "terms")
        return postings.join(small(terms, terms), "term").join(prefixes, "prefix").drop("prefix")
    keyed = prefixes.withColumn("n", F.least(F.length("prefix"), F.lit(LEAD))).withColumn("key", F.substring("prefix", 1, LEAD))
    leads = keyed.groupBy("n", "key").agg(F.count("*").alias("held")).groupBy("n").agg(F.max("held").alias("most")).collect()  # LEAD rows at most
    if max((r.most for r in leads), default=0) > LEAD_PREFIXES:
        sizes = sorted(r[0] for r in prefixes.select(F.length("prefix")).distinct().collect())  # lengths of words
        fits = F.filter(F.array(*(F.lit(n) for n in sizes)), lambda n: n <= F.length("term"))
        starts = postings.select("*", F.explode(F.transform(fits, lambda n: F.substring(F.col("term"), F.lit(1), n))).alias("prefix"))
        return starts.join(F.broadcast(prefixes), "prefix").drop("prefix")
    found = postings.select("*", F.lit(0).cast("long").alias("code")).limit(0) if not leads else None
    for n in sorted(r.n for r in leads):
        some = F.broadcast(keyed.filter(F.col("n") == n).select("key", "prefix", "code"))
        here = postings.join(some, (F.substring("term", 1, n) == F.col("key")) & F.col("term").startswith(F.col("prefix"))).drop("key", "prefix")
        found = here if found is None else found.unionByName(here)
    return found


def contributions(index: Index, queries: DataFrame, weights: Sequence[float]) -> Parts:
    """The parts of a batch of queries, each prefix's once, however many of the queries have it.

    Postings that match are dealt out once, by row, summed where they are, and written as one row of numbers for each
    of the index: frequencies and scores both read them.
    """
    phrases = scratch(phrases_of(queries, index.stemmed).groupBy("case_id", "prefix").agg(F.count("*").alias("times")), "phrases")
    prefixes = scratch(phrases.select("prefix").distinct().withColumn("code", F.monotonically_increasing_id()), "prefixes")
    weighted = sum((F.col("tf")[i] * float(w) for i, w in enumerate(weights)), F.lit(0.0))
    matched = matching(index.postings, prefixes, index).select("code", "id", "dl", weighted.alias("w"))
    by_row = _by_id(matched, index.postings.count() // TASK_POSTINGS + 1).groupBy("code", "id", "dl").agg(F.sum("w").alias("f")).groupBy("id", "dl").agg(F.collect_list(F.struct("code", "f")).alias("x"))
    hits = scratch(by_row.select("id", "dl", F.col("x.code").alias("prefixes"), F.col("x.f").alias("fs")), "found")
    df = scratch(hits.select(F.explode("prefixes").alias("code")).groupBy("code").agg(F.count("*").alias("df")), "df")
    n_docs, avgdl = index.size
    known = prefixes.join(small(df, df), "code")
    asked = phrases.join(small(known, known), "prefix").select("case_id", F.col("code").alias("prefix"), "times", "df", idf(F.lit(n_docs), F.col("df")).alias("idf"))
    return Parts(scratch(asked, "asked"), hits, avgdl)


def _summed(added: DataFrame) -> DataFrame:
    """(case_id, id, score) of (case_id, id, part)."""
    return added.groupBy("case_id", "id").agg((-F.sum("part")).alias("score"))


def scores(index: Index, queries: DataFrame, weights: Sequence[float]) -> DataFrame:
    """(case_id, id, score) of every row that matches; lower is better."""
    return _summed(contributions(index, queries, weights).added())


def rank_score() -> Column:
    """Scores to nine places: rows of equal text tie, in whatever order their parts were added."""
    return F.round("score", 9)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each case, equal scores by id. 0: none; negative: all."""
    if k < 0:
        return scored
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(rank_score(), "id"))
    return scored.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")


def _thresholds(asked: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """(case_id, theta): the k-th best sum of each query over its rarest prefixes alone; 0 if fewer rows have one. asked: case_id, prefix, times, df; parts: prefix, id, part."""
    before = F.sum("df").over(Window.partitionBy("case_id").orderBy("df", "prefix").rowsBetween(Window.unboundedPreceding, -1))
    rare = asked.withColumn("__before", F.coalesce(before, F.lit(0))).filter(F.col("__before") < FIRST_ROWS * k).select("case_id", "prefix", "times")
    best = top_k(_summed(parts.join(small(rare, rare), "prefix").withColumn("part", F.col("times") * F.col("part"))), k)
    return best.groupBy("case_id").agg(F.when(F.count("*") == k, -F.max("score")).otherwise(0.0).alias("theta"))


def best_scores(found: Parts, k: int) -> DataFrame:
    """(case_id, id, score) of rows that the k best of each query are among: all that match, or those of ``bounded`` if these are many."""
    return bounded(found, k)[0] if found.postings > BOUND_FROM else _summed(found.added())


def bounded(found: Parts, k: int) -> tuple[DataFrame, DataFrame]:
    """The rows that the k best of each query are among, scored in full, and (prefix postings that the queries have, those that were looked at).

    A prefix's postings lie in blocks by what they add, with the most that any of a block adds beside them. A query's
    prefixes are ordered by their most. The rarest prefixes alone give a k-th best score that the final one can't be
    below. A row whose highest prefix is p gets no more than its block's most and those of all prefixes
    below p: blocks where that stays under the threshold bring no candidates, so frequent prefixes, which add
    little, are hardly looked at. Rows that may still reach it for a query are summed over all prefixes, for all queries. Nothing is lost: bounds hold
    for every row, and what is within SLACK of the threshold stays.
    """
    of_prefix = found.asked.select("prefix", "idf").distinct()
    parts = found.parts(found.hits).join(small(of_prefix, of_prefix), "prefix").select("prefix", "id", (F.col("idf") * F.col("sat")).alias("part"))
    parts = parts.withColumn("level", F.floor(2 * F.log2("part")).cast("int"))
    blocks = scratch(parts.groupBy("prefix", "level").agg(F.count("*").alias("n"), F.max("part").alias("most")), "blocks")
    of_prefix = blocks.groupBy("prefix").agg(F.sum("n").alias("df"), F.max("most").alias("peak"))
    times = found.asked.select("case_id", "prefix", "times")
    asked = scratch(times.join(small(of_prefix, of_prefix), "prefix").withColumn("peak", F.col("peak") * F.col("times")), "peaks")
    theta = scratch(_thresholds(asked.select("case_id", "prefix", "times", "df"), parts, k), "theta")
    least = F.coalesce("theta", F.lit(0.0)) - SLACK

    below = F.sum("peak").over(Window.partitionBy("case_id").orderBy("peak", "prefix").rowsBetween(Window.unboundedPreceding, -1))
    ordered = asked.withColumn("below", F.coalesce(below, F.lit(0.0))).join(small(theta, theta), "case_id", "left")
    places = ordered.join(small(blocks, blocks), "prefix").withColumn("most", F.col("most") * F.col("times"))
    places = places.withColumn("opens", F.col("most") + F.col("below") >= least)
    # the most that a row can get from a prefix whose block with it doesn't open
    closed = F.coalesce(F.max(F.when(~F.col("opens"), F.col("most"))).over(Window.partitionBy("case_id", "prefix")), F.lit(0.0))
    places = scratch(places.withColumn("closed", closed).select("case_id", "prefix", "level", "times", "n", "opens", "closed"), "places")
    hidden = places.groupBy("case_id", "prefix").agg(F.first("closed").alias("closed")).groupBy("case_id").agg(F.sum("closed").alias("hidden"))
    opened = places.filter("opens").select("case_id", "prefix", "level", "times", "closed")
    # open parts count in full, in place of what their prefix could hide
    summed = parts.join(small(opened, opened), ["prefix", "level"]).groupBy("case_id", "id").agg(F.sum(F.col("times") * F.col("part") - F.col("closed")).alias("sum"))
    bound = summed.join(small(hidden, theta), "case_id").join(small(theta, theta), "case_id", "left")
    candidates = scratch(bound.filter(F.col("sum") + F.col("hidden") >= least).select("case_id", "id"), "candidates")

    # rows with a candidate, all of what they add: dealing out candidates and parts to meet by query takes more than adding up
    ids = candidates.select("id").distinct()
    score = _summed(replace(found, hits=found.hits.join(small(ids, ids), "id", "left_semi")).added())
    figures = places.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("postings"), F.coalesce(F.sum(F.when(F.col("opens"), F.col("n"))), F.lit(0)).alias("looked_at"))
    return score, figures


def search_batch(index: Index, units: DataFrame, queries: DataFrame, k: int = 5, weights: Sequence[float] = (1.0,), facets: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(case_id, score, units.*) of the best k units of each query.

    facets: column -> values, any of a column and all of the columns; an empty list doesn't filter.
    Scores don't depend on facets. The units' texts join last.
    """
    found = contributions(index, queries, weights)
    wanted = {c: list(v) for c, v in (facets or {}).items() if v}
    if wanted:
        kept = units
        for c, values in wanted.items():
            kept = kept.filter(F.col(c).isin(values))
        found.hits = found.hits.join(kept.select("id"), "id", "left_semi")
    scored = best_scores(found, k) if k > 0 else _summed(found.added())
    return top_k(scored, k).join(units, "id").select("case_id", "score", *units.columns)


def _scores_of(index: Index, prefixes: Counter[str], weights: Sequence[float]) -> DataFrame:
    """(id, score) for a few prefixes and how often each is asked for.

    The prefixes are filters on the postings, so a saved index is pruned by them; one aggregation by
    row counts all of them side by side.
    """
    names = list(prefixes)
    term = F.col("term")
    any_of = term.startswith(names[0])
    for p in names[1:]:
        any_of |= term.startswith(p)
    weighted = sum((F.col("tf")[i] * float(w) for i, w in enumerate(weights)), F.lit(0.0))
    parts = [F.sum(F.when(term.startswith(p), weighted)).alias(f"f{i}") for i, p in enumerate(names)]
    found = index.postings.filter(any_of).groupBy("id", "dl").agg(*parts)
    dfs = found.agg(*(F.count(f"f{i}").alias(f"df{i}") for i in range(len(names))))
    rows = found.join(F.broadcast(dfs))  # one row
    n_docs, avgdl = index.size
    norm = K1 * (1 - B + B * F.col("dl") / F.lit(avgdl))
    score = F.lit(0.0)
    for i, p in enumerate(names):
        f = F.col(f"f{i}")
        score -= prefixes[p] * F.coalesce(idf(F.lit(n_docs), F.col(f"df{i}")) * f * (K1 + 1) / (f + norm), F.lit(0.0))
    return rows.select("id", score.alias("score"))


def search(index: Index, units: DataFrame, query: str, k: int = 5, weights: Sequence[float] = (1.0,), facets: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """The best k units for one query, best first: score and the units' columns. Nothing if no token is usable.

    Up to MAX_IN_PLAN rows are found when this is called; the result then only reads their units.
    """
    tokens = [t.lower() for t in re.findall(QUERY_TOKEN, query) if len(t) >= MIN_QUERY_TOKEN]
    prefixes = Counter(stem_word(t) if index.stemmed else t for t in tokens)
    if not prefixes:
        return units.limit(0).select(F.lit(0.0).alias("score"), *units.columns)
    if len(prefixes) <= MAX_IN_PLAN:
        scored = _scores_of(index, prefixes, weights)
    else:
        scored = scores(index, units.sparkSession.range(1).select(F.col("id").alias("case_id"), F.lit(query).alias("query")), weights)
    for c, values in (facets or {}).items():
        if values:
            scored = scored.join(units.filter(F.col(c).isin(list(values))).select("id"), "id", "left_semi")
    scored = scored.select("id", "score").orderBy(rank_score(), "id")
    if 0 <= k <= MAX_IN_PLAN:  # few rows: their units are looked up by id, which prunes a saved table
        best = scored.limit(k).collect()
        score_of = F.create_map(*(F.lit(x) for r in best for x in (r.id, r.score))) if best else F.lit(None)
        hits = units.filter(F.col("id").isin([r.id for r in best])) if best else units.limit(0)
        score = score_of[F.col("id")] if best else F.lit(0.0)
        return hits.select(score.alias("score"), *units.columns).orderBy(rank_score(), "id")
    best = scored.limit(k) if k >= 0 else scored
    return best.join(units, "id").select("score", *units.columns).orderBy(rank_score(), "id")
