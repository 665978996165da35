"""Benchmark decontamination by winnowing, with built-in functions only.

Words are hashed, hashes of k consecutive words are formed by doubling, and in every window of w such
k-grams the least is the window's fingerprint; any shared span of w + k - 1 words shares one, and its place.
Fingerprints of the documents, with their places, join those of the benchmark; around the hits, and
there alone, the documents' windows are compared word for word with the benchmark's. Benchmark texts
shorter than the span have fingerprints of their own, for windows as long as the shortest of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import Stash, row_key, rows_fit, salted, text_of

SPAN, K = 13, 8
#: Up to this number, benchmark fingerprints (a number each, some 16 MB) are broadcast; beyond it they are joined by shuffle.
PRINT_ROWS = 1_000_000
#: Up to this number, benchmark windows (a string and an item each, some 30 MB) are broadcast; beyond it they are joined by shuffle.
WINDOW_ROWS = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that part words.
APART = "".join(c for c in map(chr, range(128)) if not c.isalnum() and c != " ")


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f refers to it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def words_of(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, A-Z (and nothing else) lower-cased."""
    plain = F.translate(text, APART + UPPER, " " * len(APART) + LOWER)
    return F.array_remove(F.split(plain, " "), "")


def _pairs(x: Column, by: int, f: Callable[[Column, Column], Column]) -> Column:
    """f(x[i], x[i + by]) for every i with both."""

    def zipped(x: Column) -> Column:
        n = F.greatest(F.size(x) - by, F.lit(0))
        return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(by + 1), n), f)

    return _let(x, zipped)


@dataclass(frozen=True)
class Winnow:
    """Windows of ``span`` words: w k-grams of k (a power of two) words each."""

    span: int

    @property
    def k(self) -> int:
        return min(K, 1 << (self.span.bit_length() - 1))

    @property
    def w(self) -> int:
        return self.span - self.k + 1

    def prints(self, words: Column) -> Column:
        """The least k-gram hash of every window, in order."""
        x, have = F.transform(words, lambda w: F.xxhash64(w)), 1
        while have < self.k:
            x, have = _pairs(x, have, lambda a, b: F.xxhash64(a, b)), 2 * have
        have = 1
        while have < self.w:
            by = min(have, self.w - have)
            x, have = _pairs(x, by, lambda a, b: F.least(a, b)), have + by
        return x

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with words), for every fingerprint: at, print.

        A window with the fingerprint of the one before is left to it, as long as that is less than w windows
        back: the windows of a fingerprint are those from ``at`` to ``at`` + w - 1 at most.
        """
        rows = rows.withColumn("__m", self.prints(F.col("words")))
        before = F.concat(F.array(F.lit(None).cast("long")), F.slice("__m", F.lit(1), F.greatest(F.size("__m") - 1, F.lit(0))))
        rows = rows.withColumn("__b", before).select("*", F.posexplode(F.arrays_zip("__m", "__b")).alias("at", "__x")).drop("__m", "__b")
        new = F.col("__x.__m").isNotNull() & ((F.col("at") % self.w == 0) | ~F.col("__x.__m").eqNullSafe(F.col("__x.__b")))
        return rows.filter(new).withColumn("print", F.col("__x.__m")).drop("__x")


def windows_of(words: Column, lengths: list[int]) -> Column:
    """(pos, n, window) of every run of n words, for each n of ``lengths``, as one string each."""

    def runs(words: Column) -> Column:
        def of(n: int) -> Column:
            at = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
            return F.transform(at, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("n"), F.array_join(F.slice(words, i + 1, F.lit(n)), " ").alias("window")))

        return F.concat(*map(of, lengths))

    return _let(words, runs)


def _near_hits(docs: DataFrame, winnow: Winnow, prints: DataFrame, longest: int) -> DataFrame:
    """(key, at, near) of the fingerprints that ``docs`` (key, words) shares with ``prints``: the words that their windows may reach."""
    near = F.slice("words", F.col("at") + 1, F.lit(winnow.w - 1 + longest)).alias("near")
    if rows_fit(prints, PRINT_ROWS):
        return winnow.placed(docs).join(F.broadcast(prints), "print", "left_semi").select("key", "at", near)
    hits = salted(winnow.placed(docs).select("key", "at", "print"), prints, ["print"], "left_semi")
    hits = Stash(hits.groupBy("key").agg(F.collect_set("at").alias("ats")), "hits").df
    return docs.join(hits, "key").withColumn("at", F.explode("ats")).select("key", "at", near)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted item ids as strings), contaminated.

    A window is 13 consecutive words of an item, or the whole item if it has fewer, but not none. A
    document word inside any occurrence of a window is hit; items are those with occurring windows.
    Contaminated: n_hit > 0 and 20 * n_hit >= n_words. Null and empty texts have no words and null item ids
    are left out; repeated items count once and repeated documents get the same result. Texts of any
    length are judged whole; a text has to fit an executor's memory some ten times over. Without items
    nothing is hit; without documents the result is empty. Other columns stay; those of the result's
    names are replaced.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(text_of()).alias("words")).filter("item is not null and size(words) > 0")
    items = Stash(items.withColumn("n", F.least(F.size("words"), F.lit(SPAN))), "items").df
    lengths = sorted(r[0] for r in items.select("n").distinct().collect())  # at most SPAN numbers
    spans = items.select("item", "n", F.explode(windows_of(F.col("words"), lengths or [SPAN])).alias("x")).filter("n = x.n")
    spans = Stash(spans.select("n", "x.window", "item").distinct(), "spans").df
    known = spans.groupBy("n", "window").agg(F.collect_set("item").alias("items"))
    few = rows_fit(spans, WINDOW_ROWS)

    keyed = docs.select(row_key(id_col, text_col).alias("key"), words_of(text_of(text_col)).alias("words"))
    hits = None
    for these in ([n for n in lengths if n < SPAN], [n for n in lengths if n == SPAN]):
        if these:
            # all windows of long items, the first one of short items
            winnow = Winnow(these[0])
            own = items.filter(F.col("n").isin(these)).withColumn("words", F.col("words") if these[0] == SPAN else F.slice("words", F.lit(1), F.lit(these[0])))
            prints = Stash(winnow.placed(own).select("print").distinct(), "prints").df
            near = _near_hits(keyed, winnow, prints, these[-1])
            at = near.select("key", "at", F.explode(windows_of(F.col("near"), these)).alias("x")).filter(F.col("x.pos") < winnow.w)
            at = at.select("key", (F.col("at") + F.col("x.pos")).alias("pos"), "x.n", "x.window")
            found = at.join(F.broadcast(known), ["n", "window"]) if few else salted(at, known, ["n", "window"])
            found = found.select("key", "pos", "n", "items")
            hits = hits.unionByName(found) if hits is not None else found

    if hits is None:
        return docs.withColumns({"n_words": F.size(words_of(text_of(text_col))).cast("long"), "n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>"), "contaminated": F.lit(False)})
    spots = F.array_sort(F.collect_set(F.struct("pos", "n")))
    per_doc = hits.groupBy("key").agg(spots.alias("spots"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("__items"))

    def cover(acc: Column, s: Column) -> Column:
        """n words from each place, less what runs before have covered."""
        end = F.greatest(acc["end"], s["pos"] + s["n"])
        return F.struct((acc["hit"] + end - F.greatest(acc["end"], s["pos"])).alias("hit"), end.alias("end"))

    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))
    per_doc = per_doc.select(F.col("key").alias("__key"), F.aggregate("spots", start, cover)["hit"].cast("long").alias("__hit"), "__items")
    per_doc = Stash(per_doc, "hits").df

    out = docs.withColumn("__key", row_key(id_col, text_col)).withColumn("n_words", F.size(words_of(text_of(text_col))).cast("long"))
    out = out.join(per_doc, "__key", "left").withColumn("n_hit", F.coalesce("__hit", F.lit(0).cast("long")))
    out = out.withColumn("items", F.coalesce("__items", F.array().cast("array<string>"))).drop("__key", "__hit", "__items")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
