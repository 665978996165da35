"""A corpus from elements: units, metadata, index; built, resumed, loaded, audited."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators import enrich as en
from lectern.operators.index import Index, build_index
from lectern.operators.layout import Profile
from lectern.operators.search import UNIT_WEIGHTS, search
from lectern.operators.segments import chapter_spans, in_sections, page_spans, section_texts, units_of, with_section_text
from lectern.sources.checkpoints import ROWS, read_checkpoint, start_anew, write_checkpoint
from lectern.sources.config import Prompt
from lectern.sources.scratch import scratch, spread

#: Batches of a build at most: each is a Spark job.
MAX_BATCHES = 1000
UNIT_COLUMNS = (
    "id long, principle string, chapter string, section string, type string, page int, text string, context_line string, "
    "applies_when string, key_terms string, questions string, enrich_model string, needs_enrich int, doc_id long"
)


@dataclass
class Corpus:
    """Units (the rows, the source of truth) and their index."""

    units: DataFrame
    index: Index

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Corpus:
        units = spark.read.schema(UNIT_COLUMNS).parquet(f"{path}/units")
        return cls(units, Index.load(spark, f"{path}/index", list(UNIT_WEIGHTS), True))

    def search(self, query: str, k: int = 5, principles: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
        return search(self.index, self.units, query, k, list(UNIT_WEIGHTS.values()), {"principle": principles or [], "type": types or []})

    def audit(self) -> DataFrame:
        return audit(self.units)


def audit(units: DataFrame) -> DataFrame:
    """(facet, value, n): numbers of units by principle, chapter, type and needs_enrich, and of all."""
    facets = [F.struct(F.lit(k).alias("facet"), F.col(k).cast("string").alias("value")) for k in ("principle", "chapter", "type", "needs_enrich")]
    sets = units.select(F.explode(F.array(*facets, F.struct(F.lit("all").alias("facet"), F.lit("").alias("value")))).alias("x"))
    return sets.groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def with_ids(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with dense ids from 1 in the order of some columns: ranges are numbered side by side, the driver adds up their sizes."""
    parts = scratch(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    before, n = [], 0
    for part, size in sorted(tuple(r) for r in parts.groupBy("__part").count().collect()):
        before.append((part, n))
        n += size
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "__part int, __before long"))  # a row for each partition
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.withColumn("__nth", nth).join(offsets, "__part").withColumn("id", F.col("__before") + F.col("__nth")).drop("__part", "__nth", "__before")


def write_corpus(rows: DataFrame, path: str) -> None:
    """Rows (CHECKPOINT columns, ``position``, of any type, for their order in a document) as units with dense ids from 1, and the index over them.

    Types are checked; lists are stored as their joined values.
    """
    units = with_ids(rows, ["doc_id", "position"])
    units = units.withColumn("type", en.checked_type(F.col("type"))).withColumn("needs_enrich", F.coalesce("needs_enrich", F.lit(0)))
    for c in en.LISTS:
        units = units.withColumn(c, F.array_join(c, " "))
    spark = rows.sparkSession
    units.select(*(c.split()[0] for c in UNIT_COLUMNS.split(", "))).write.mode("overwrite").parquet(f"{path}/units")
    written = spark.read.schema(UNIT_COLUMNS).parquet(f"{path}/units")
    build_index(written, list(UNIT_WEIGHTS)).save(f"{path}/index")


def in_plan_order(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Checkpoint rows (one for each unit, ``position`` for when it was first saved) with ``position`` as ``units`` (IDENTITY, seq, page) order them.

    So it doesn't matter in which attempts and batches they were saved: a unit that stands in several places has its first
    one's position and its last one's page. Rows of units that are gone come last in their chapter, as they were saved.
    """
    places = units.groupBy(*en.IDENTITY).agg(F.min("seq").alias("__place"), F.max_by("page", "seq").alias("__page"))
    ends = units.groupBy("doc_id", "chapter").agg(F.max("seq").alias("__end"))
    placed = rows.join(places, en.IDENTITY, "left").join(ends, ["doc_id", "chapter"])
    gone = F.col("__place").isNull()
    position = F.struct(F.coalesce("__place", "__end").alias("seq"), gone.alias("gone"), F.when(gone, F.col("position")).alias("saved"))
    return placed.withColumns({"position": position, "page": F.when(gone, F.col("page")).otherwise(F.col("__page"))}).drop("__place", "__page", "__end")


def plan_units(elements: DataFrame, profile: Profile, chapter: str | None = None) -> DataFrame:
    """Units with section text. One chapter if asked for (an error if there is none), else all and the appendices."""
    spans = page_spans(elements, profile.chapter_pages) if profile.chapter_pages else chapter_spans(elements, profile.chapter_re)
    spans = spans.select(*elements.columns, "chapter", "span_ord")
    if chapter is not None:
        spans = spans.filter(F.col("chapter") == str(chapter))
        if not spans.limit(1).count():
            raise ValueError(f"no chapter {chapter}")
    elif profile.appendices:
        spans = spans.unionByName(page_spans(elements, profile.appendices, 1_000_000).select(*spans.columns))
    sectioned = in_sections(spans, profile)
    return with_section_text(units_of(sectioned), section_texts(sectioned))


def build(
    elements: DataFrame, profile: Profile, principles: DataFrame, topics: DataFrame, prompt: Prompt, extractor: en.Extractor, checkpoint: str, path: str,
    chapter: str | None = None, resume: bool = False, workers: int | None = None, prune_stale: bool = False,
    save_every: int = 1000, say: Callable[[str], None] = lambda line: None,
) -> DataFrame:
    """Builds a corpus at ``path`` and returns the report (chapter, units, failed); ``say`` gets its lines as text.

    Work is saved at ``checkpoint``, every ``save_every`` units or thousandth of the units, whichever is more: a build
    that breaks off loses those at most, and what it had written of them isn't read. ``resume`` skips units that succeeded before and tries failed ones again. The first unit is enriched
    alone, so that the extractor settles before it is sent to the workers. All rows of the checkpoint's
    built chapters are loaded, also of units that are gone, unless ``prune_stale``. Units of several
    documents stay apart. An extractor with a ``num_ctx`` gets one that holds the longest prompt.
    """
    spark = elements.sparkSession
    units = plan_units(elements, profile, chapter)
    units = units.withColumn("principle", F.lit(None).cast("string"))
    units = en.override_principle(units, topics)
    cards = principles.select("slug", en.card({c: F.col(c) for c in ("vocabulary", "diagnostics", "red_flags")}, F.col("slug"), F.col("name")).alias("card"))
    units = en.with_cards(units, cards)
    names = F.col("section"), F.col("is_code"), F.col("text")
    units = units.withColumn("digest", en.unit_digest(*names)).withColumn("key", en.unit_key(*names))
    units = units.withColumn("prompt", en.render_prompt(prompt.template, F.col("card"), F.col("section_text"), F.col("text")))
    units = units.withColumn("seq", F.col("span_ord") * 10**9 + F.col("unit_ord"))
    units = scratch(units.select("doc_id", "digest", "key", "text", "chapter", "section", "page", "is_code", "prompt", "seq"), "units")

    num_ctx, over = en.context_size(units, prompt.system).first()
    if hasattr(extractor, "num_ctx"):
        extractor.num_ctx = num_ctx
    n_units, n_chapters = units.agg(F.count("*"), F.count_distinct("doc_id", "chapter")).first()
    say(f"chapters={n_chapters} units={n_units} num_ctx={num_ctx} model={getattr(extractor, 'model', 'stub')}")
    if over:
        say(f"WARNING: the longest prompt needs more than num_ctx={en.CONTEXT_CAP}; shorten the section texts")

    if not resume:
        start_anew(units, checkpoint)
    before = read_checkpoint(spark, checkpoint)
    attempt = before.agg(F.coalesce(F.max("attempt"), F.lit(-1))).first()[0] + 1
    todo = scratch(en.pending(units, before), "todo")
    first = todo.orderBy("doc_id", "seq").limit(1).collect()
    for row in first:
        got = en.enrich_one(extractor, row.prompt, row.is_code, prompt.system)
        done = {**row.asDict(), **got, "type": "code" if row.is_code else got["type"], "enrich_model": getattr(extractor, "model", "stub"), "attempt": attempt}
        write_checkpoint(spark.createDataFrame([tuple(done[c.split()[0]] for c in ROWS.split(", "))], ROWS), checkpoint, f"{attempt}-first")
    rest = todo.filter(~((F.col("doc_id") == first[0].doc_id) & (F.col("chapter") == first[0].chapter) & (F.col("digest") == first[0].digest))) if first else todo
    batches = min(max(1, -(-todo.count() // save_every)), MAX_BATCHES)
    dealt = rest.withColumn("batch", F.pmod(F.xxhash64(*en.IDENTITY), F.lit(batches)).cast("int"))
    dealt = scratch(dealt.repartition("batch"), "batches", by=("batch",))  # so that a batch reads its own rows only
    for i in range(batches):
        some = dealt.filter(F.col("batch") == i).drop("batch")
        write_checkpoint(en.enrich(some if workers else spread(some), extractor, prompt.system, workers=workers).withColumn("attempt", F.lit(attempt)), checkpoint, f"{attempt}-{i}")

    rows = read_checkpoint(spark, checkpoint).join(units.select("doc_id", "chapter").distinct(), ["doc_id", "chapter"], "left_semi")
    if prune_stale:
        rows = rows.join(units.select(*en.IDENTITY).distinct(), en.IDENTITY, "left_semi")
    rows = in_plan_order(en.last_wins(rows.withColumn("order", F.struct("attempt", "seq")), en.IDENTITY, "order"), units)
    write_corpus(en.override_principle(rows, topics), path)
    written = spark.read.schema(UNIT_COLUMNS).parquet(f"{path}/units")
    _tell(written, say, path)
    return en.build_report(written)


def _tell(units: DataFrame, say: Callable[[str], None], path: str) -> None:
    """The report as lines: each chapter in the order of its units, the failures, the total."""
    chapters = units.groupBy("chapter").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.sum("needs_enrich").alias("failed"), F.first("principle").alias("principle"))
    n = failed = 0
    for r in chapters.orderBy("id").toLocalIterator():
        say(f"  {r.chapter}: {r.n} units ({r.failed} failed) principle={r.principle or 'null'}")
        n, failed = n + r.n, failed + r.failed
    if failed:
        say(f"WARNING: {failed} of {n} units failed; does the model give structured answers?")
    say(f"built {n} units ({failed} failed) -> {path}")
