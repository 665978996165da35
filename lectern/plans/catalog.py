"""The queries of the engine's own operators and the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.stem import stems
from lectern.functions.text import fold, match_query, query_tokens, raw_tokens, trim_ws
from lectern.operators import enrich as en
from lectern.operators import evaluate, layout, render, segments
from lectern.operators.corpus import audit, in_plan_order, with_ids
from lectern.operators.index import build_index
from lectern.operators.living_index import LivingIndex
from lectern.operators.search import expand, idf, search, search_batch
from lectern.plans.fixtures import EVENT_PROFILE, LINE_PROFILE, document_units, event_elements, line_spans, table, whole_spans
from lectern.plans.oracle import ORACLE  # noqa: F401
from lectern.sources import checkpoints
from lectern.sources.html import html_elements, html_rows
from lectern.sources.scratch import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FIXED_QUERY = "the entire station onion"
PAGE_RANGES, APPENDIX_RANGES = {"1": (10, 99), "2": (100, 399)}, {"a": (50, 149), "b": (700, 10**9)}
TEMPLATE = "CARD {{of}} the source:\n{card}\nSECTION:\n{section}\nPASSAGE:\n{passage}"
PAYLOAD = {"principle": "p", "type": "example", "context_line": "c", "applies_when": "w", "key_terms": ["k1", "k2"], "questions": ["q"]}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# ---- layout


@query
def lines_nonblank(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.filter(layout.is_solid(F.col("line"))).withColumn("line", trim_ws(F.col("line")))


@query
def html_layout(spark, d):
    return html_rows(table(spark, d, "pages"))


@query
def html_headings(spark, d):
    return html_elements(table(spark, d, "pages"))


@query
def line_class_share(spark, d):
    lines = layout.class_lines(line_spans(table(spark, d, "documents")), LINE_PROFILE)
    return lines.select("doc_id", "line", "kind", "level", "text")


@query
def page_range_scan(spark, d):
    pages = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("int").alias("page"), "n_chars")
    pages = layout.page_range(pages, 0, None)
    both = segments.page_spans(pages, PAGE_RANGES).unionByName(segments.page_spans(pages, APPENDIX_RANGES, 1 + len(PAGE_RANGES)))
    return both.select("chapter", "span_ord", "doc_id", "n_chars")


@query
def figure_filter(spark, d):
    part = table(spark, d, "part")
    blocks = part.select(
        F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("block"), F.lit(0).alias("line"), F.lit(1).alias("block_type"),
        F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("p_size").cast("double").alias("x1"), F.col("p_retailprice").alias("y1"),
    )
    return layout.figures(blocks, LINE_PROFILE).select("doc_id", "text")


# ---- chapters, sections, units


@query
def chapter_spans(spark, d):
    elements = event_elements(table(spark, d, "events"), {"signup": ("heading", 1)})
    return segments.chapter_spans(elements, EVENT_PROFILE.chapter_re).select("doc_id", "ord", "chapter", "span_ord", "span_start", "span_end")


@query
def section_ffill(spark, d):
    elements = event_elements(table(spark, d, "events"), {"error": ("heading", 2)})
    return segments.in_sections(whole_spans(elements), EVENT_PROFILE).select("doc_id", "ord", "section")


@query
def stop_rule(spark, d):
    elements = event_elements(table(spark, d, "events"), {"signup": ("heading", 1), "view": ("figure", 0)})
    return segments.in_sections(whole_spans(elements), EVENT_PROFILE).select("doc_id", "ord", "kind")


@query
def code_runs(spark, d):
    elements = event_elements(table(spark, d, "events"), {"purchase": ("code", 0), "view": ("figure", 0)}).filter("kind <> 'figure'")
    return layout.join_runs(elements, "code", ["doc_id"]).filter("kind = 'code'").select("doc_id", "ord", "text", "page")


@query
def prose_runs(spark, d):
    elements = event_elements(table(spark, d, "events"), {"signup": ("heading", 2), "error": ("heading", 2), "purchase": ("code", 0), "view": ("figure", 0)})
    units = segments.units_of(segments.in_sections(whole_spans(elements), EVENT_PROFILE))
    return units.select("doc_id", "unit_ord", "section", "text", "page", "is_code")


@query
def section_texts(spark, d):
    turns = table(spark, d, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.when(F.col("role") == "user", "heading").otherwise("para").alias("kind"),
        F.when(F.col("role") == "user", F.concat(F.col("turn").cast("string"), F.lit(".0"))).otherwise(F.col("text")).alias("text"),
        F.lit(1).alias("page"), F.when(F.col("role") == "user", 2).otherwise(0).alias("level"),
    )
    sectioned = segments.in_sections(whole_spans(turns), EVENT_PROFILE)
    units = segments.with_section_text(segments.units_of(sectioned), segments.section_texts(sectioned))
    texts = segments.section_texts(sectioned).select("doc_id", "section", "section_text")
    n = units.groupBy("doc_id", "section").agg(F.count("*").alias("n_units"))
    return texts.join(n, ["doc_id", "section"], "left").withColumn("n_units", F.coalesce("n_units", F.lit(0)))


# ---- enrichment


@query
def unit_key(spark, d):
    return table(spark, d, "documents").select("doc_id", en.unit_key(F.col("source"), F.col("doc_id") % 2 == 0, F.col("text")).alias("key"))


@query
def dedup_last_wins(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return en.last_wins(rows, ["user_id"], "event_id").drop("event_id")


@query
def pending_anti(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"))
    checkpoint = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("key"), F.col("toxic").alias("needs_enrich"))
    return en.pending(docs, checkpoint, ["key"]).select("doc_id")


@query
def principle_override(spark, d):
    named = F.when(F.col("r_name") != "AFRICA", F.lower("r_name"))
    topics = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    topics = topics.select(F.col("n_nationkey").alias("chapter"), F.col("n_nationkey").alias("ord"), named.alias("principle"))
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("chapter"), F.lit("model says").alias("principle"))
    return en.override_principle(rows, topics).select("c_custkey", "chapter", "principle")


@query
def card_render(spark, d):
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lists = nations.groupBy("r_name").agg(
        F.array_sort(F.collect_list("n_name")).alias("vocabulary"), F.array_sort(F.collect_list(F.when(F.col("n_nationkey") % 5 == 0, F.col("n_name")))).alias("red_flags")
    )
    cards = lists.select(F.col("r_name").alias("slug"), en.card({"vocabulary": F.col("vocabulary"), "diagnostics": F.array().cast("array<string>"), "red_flags": F.col("red_flags")}, F.col("r_name"), F.initcap("r_name")).alias("card"))
    rows = nations.select("n_nationkey", F.when(F.col("n_nationkey") < 22, F.col("r_name")).alias("principle"))
    return en.with_cards(rows, cards).select("n_nationkey", "card")


@query
def code_type_force(spark, d):
    turns = table(spark, d, "conversations")
    is_code = F.col("role") == "system"
    kind = en.typed(is_code, F.when(F.col("role") == "user", "example").otherwise("rationale"))
    return turns.select("conv_id", "turn", en.checked_type(kind).alias("type"), en.unit_key(F.col("role"), is_code, F.col("text")).alias("key"), F.lit(0).alias("needs_enrich"))


@query
def prompt_render(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return rows.select("doc_id", en.render_prompt(TEMPLATE, F.col("source"), F.col("lang"), F.col("text")).alias("prompt"))


@query
def ctx_size(spark, d):
    return en.context_size(table(spark, d, "documents").select(F.col("text").alias("prompt")), "You enrich passages.")


@query
def build_report(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return en.build_report(rows.select(F.col("lang").alias("chapter"), F.when(F.col("quality").isNull(), 1).otherwise(0).alias("needs_enrich")))


@query
def facet_audit(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    kind = F.when(F.col("quality") == 1, "example").otherwise("rationale")
    units = docs.select(F.col("source").alias("principle"), F.col("lang").alias("chapter"), kind.alias("type"), F.coalesce("toxic", F.lit(0)).alias("needs_enrich"))
    return audit(units)


@query
def resumed_order(spark, d):
    """Turns as units that were saved out of order, in three attempts; those from turn 6 on are gone from the plan."""
    turns = table(spark, d, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.when(F.col("turn") < 3, "1").otherwise("2").alias("chapter"), F.sha1("text").alias("digest"), F.col("turn").cast("long").alias("seq"),
        ((F.col("conv_id") + F.col("turn") * 2) % 3).cast("int").alias("attempt"), F.col("turn").cast("int").alias("page"),
    )
    rows = en.last_wins(turns.withColumn("order", F.struct("attempt", "seq")), en.IDENTITY, "order")
    return with_ids(in_plan_order(rows, turns.filter("seq < 6")), ["doc_id", "position"]).select("id", "doc_id", "chapter", "digest", "page", "attempt")


@query
def committed_batches(spark, d):
    """Turns as checkpoint rows in batches by conversation: two that are whole, one of them written twice, one that broke off; then a chapter starts anew."""
    turns = table(spark, d, "conversations")
    blank = {c: F.lit(None).cast(t) for c, t in (x.split(" ", 1) for x in checkpoints.ROWS.split(", ")) if c not in ("doc_id", "key", "text", "chapter", "seq", "attempt")}
    rows = turns.select(
        F.col("conv_id").alias("doc_id"), F.sha1("text").alias("key"), "text", F.col("role").alias("chapter"), F.col("turn").cast("long").alias("seq"), F.lit(0).alias("attempt")
    ).withColumns(blank)
    path = f"{scratch_dir(spark)}/checkpoint-{uuid.uuid4().hex}"
    for batch in (0, 1, 1):
        checkpoints.write_checkpoint(rows.filter(F.col("doc_id") % 3 == batch), path, f"0-{batch}")
    checkpoints._write(rows.filter(F.col("doc_id") % 3 == 2), path)  # and no manifest
    checkpoints.start_anew(rows.filter("chapter = 'system'"), path)
    checkpoints.write_checkpoint(rows.filter("chapter = 'system' and seq = 0 and doc_id % 3 = 2").withColumn("attempt", F.lit(1)), path, "1-0")
    return checkpoints.read_checkpoint(spark, path).select("doc_id", "chapter", "seq", "attempt", "key")


@query
def enrich_stub(spark, d):
    turns = table(spark, d, "conversations")
    units = turns.select(
        en.unit_key(F.col("role"), F.col("role") == "system", F.col("text")).alias("key"), "text", F.col("conv_id").cast("string").alias("chapter"), F.col("role").alias("section"),
        F.col("turn").cast("int").alias("page"), (F.col("role") == "system").alias("is_code"), F.concat(F.lit("PASSAGE: "), "text").alias("prompt"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
    )
    rows = en.enrich(units, en.StubExtractor(PAYLOAD))
    return rows.select("seq", "key", "chapter", "section", "page", "enrich_model", "needs_enrich", "principle", "type", "context_line", "applies_when", F.array_join("key_terms", " ").alias("key_terms"), F.array_join("questions", " ").alias("questions"))


# ---- index and search


def _documents(spark, d, stemmed=False):
    units = document_units(table(spark, d, "documents"))
    return units, build_index(units.select("id", "text"), ["text"], stemmed)


def _score(c="score"):
    return F.round(c, 6).alias(c)


@query
def match_query_text(spark, d):
    return table(spark, d, "benchmark").select("item_id", match_query(F.col("text")).alias("match"), F.size(query_tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query
def doc_stats(spark, d):
    _, index = _documents(spark, d)
    return index.lengths.join(index.postings.groupBy("id").agg(F.count("*").alias("terms")), "id", "left").select("id", "dl", F.coalesce("terms", F.lit(0)).alias("terms"))


@query
def term_df_idf(spark, d):
    _, index = _documents(spark, d)
    vocabulary = index.vocabulary().join(F.broadcast(index.corpus()))
    return vocabulary.select("term", "df", F.round(idf(F.col("n_docs"), F.col("df")), 6).alias("idf"), F.round("avgdl", 6).alias("avgdl"))


@query
def prefix_expand(spark, d):
    _, index = _documents(spark, d)
    prefixes = table(spark, d, "benchmark").select(F.explode(query_tokens(F.col("text"))).alias("t")).select(F.lower("t").alias("prefix")).distinct()
    return expand(prefixes, index.blocks).select("prefix", "term")


@query
def bm25_topk(spark, d):
    units, index = _documents(spark, d)
    hits = search(index, units, FIXED_QUERY, 10, (10.0,))
    return hits.select(_score(), "id", "section", "principle", "n_chars")


@query
def bm25_weighted(spark, d):
    elements = html_elements(table(spark, d, "pages"))
    part = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "text")))), lambda x: x["text"]), "\n")
    units = elements.groupBy(F.col("page_id").alias("id")).agg(part("heading").alias("title"), part("para").alias("body"))
    index = build_index(units, ["title", "body"], False)
    return search(index, units, "the station de que", 20, (10.0, 4.0)).select(_score(), "id")


@query
def bm25_faceted(spark, d):
    units, index = _documents(spark, d)
    hits = search(index, units, FIXED_QUERY, 10, (10.0,), {"section": ["en", "fr"], "principle": ["src1", "src2", "src3", "src4"]})
    return hits.select(_score(), "id", "section", "principle")


def _passages(spark, d):
    """All passages, whole, as queries."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("query"))


def _cases(spark, d):
    """The passages; the expected principle is the source of the least document that holds the passage."""
    items = _passages(spark, d)
    holds = evaluate.holders(table(spark, d, "documents").select("doc_id", "text", "source"), items)
    return items.join(holds.groupBy("case_id").agg(F.min_by("source", "doc_id").alias("expect_principle")), "case_id", "left").withColumn("expect_section", F.lit(None).cast("string"))


@query
def passage_holders(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return evaluate.holders(docs, _passages(spark, d)).select("case_id", "doc_id")


@query
def index_changes(spark, d):
    """An index of documents that were added in two writes, of which a fifth was replaced and a seventh deleted, some to be added again."""
    units = document_units(table(spark, d, "documents"))
    index = LivingIndex(spark, f"{scratch_dir(spark)}/living-{uuid.uuid4().hex}", ["text"], False, fan=3)
    late, gone = F.col("id") % 4 == 3, F.col("id") % 7 == 2
    changed = F.when(F.col("id") % 5 == 1, F.concat(F.lit("the station entire "), F.col("text"))).otherwise(F.col("text"))
    index.write(units.filter(~late).select("id", "text"))
    index.delete(units.filter(gone).select("id"))
    index.write(units.filter(late & ~gone).select("id", "text"))
    index.write(units.filter((F.col("id") % 5 == 1) & ~gone).select("id", changed.alias("text")))
    index.write(units.filter(gone & (F.col("id") % 2 == 0)).select("id", "text"))
    return search(index.index(), units, FIXED_QUERY, 20, (10.0,)).select(_score(), "id", "section")


@query
def eval_topk(spark, d):
    units, index = _documents(spark, d)
    hits = search_batch(index, units, _passages(spark, d), 5, (10.0,))
    return hits.select("case_id", _score(), "id")


@query
def eval_hit_rate(spark, d):
    units, index = _documents(spark, d)
    return evaluate.score_cases(index, units, _cases(spark, d), 5, (10.0,)).select(F.round("hit_rate", 6).alias("hit_rate"), "n")


@query
def json_hits(spark, d):
    units, index = _documents(spark, d)
    hits = search(index, units, FIXED_QUERY, 5, (10.0,))
    return render.json_rows(hits.select("id", "section", "principle", "n_chars"))


@query
def citations(spark, d):
    units, index = _documents(spark, d)
    hits = search(index, units, FIXED_QUERY, 5, (10.0,)).withColumn("page", F.col("n_chars")).withColumn("type", F.lit("rationale"))
    return hits.select("id", render.citation().alias("citation"))


@query
def porter_vocab(spark, d):
    tokens = table(spark, d, "documents").select(F.explode(raw_tokens(F.col("text"))).alias("t")).distinct().select(fold(F.col("t")).alias("token")).distinct()
    return tokens.withColumn("stem", stems(F.col("token")))


@query
def bm25_stemmed(spark, d):
    units, index = _documents(spark, d, True)
    return search(index, units, FIXED_QUERY, 10, (10.0,)).select(_score(), "id", "section", "principle")
