"""Chapters, sections and retrieval units as window plans over ordered elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import joined, match_start, trim_ws
from lectern.operators.layout import Profile, run_ids

UNITS = "chapter string, section string, unit_ord long, text string, page int, is_code boolean"


def chapter_spans(elements: DataFrame, chapter_re: str) -> DataFrame:
    """Elements with chapter, span_ord and the ordinals [span_start, span_end) of their span.

    A span runs from one level-1 heading that matches ``chapter_re`` (group 1 is the id) to the next;
    what stands before the first is dropped. Spans with one id stay apart. No pattern, no spans.
    """
    marker = match_start(trim_ws(F.col("text")), chapter_re) if chapter_re else F.lit(None).cast("string")
    marked = elements.withColumn("__id", F.when((F.col("kind") == "heading") & (F.col("level") == 1), marker))
    order = Window.partitionBy("doc_id").orderBy("ord")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    start = F.when(F.col("__id").isNotNull(), F.col("ord"))
    marked = (
        marked.withColumn("chapter", F.last("__id", ignorenulls=True).over(upto))
        .withColumn("span_ord", F.count("__id").over(upto))
        .withColumn("span_start", F.last(start, ignorenulls=True).over(upto))
        .withColumn("__end", F.max("ord").over(Window.partitionBy("doc_id")) + 1)
        .filter("chapter is not null")
    )
    following = F.min(F.when(F.col("__id").isNotNull(), F.col("ord"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    return marked.withColumn("span_end", F.coalesce(following, "__end")).drop("__id", "__end")


def page_spans(elements: DataFrame, ranges: dict[str, tuple[int, int]], first_span: int = 1) -> DataFrame:
    """Elements of the pages of each range, ends included; a page may belong to several. Ranges come from a profile."""
    rows = [F.struct(F.lit(c).alias("chapter"), F.lit(i).cast("long").alias("span_ord"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (c, (a, b)) in enumerate(ranges.items(), first_span)]
    known = F.array(*rows) if rows else F.array().cast("array<struct<chapter:string,span_ord:bigint,a:int,b:int>>")
    held = F.filter(known, lambda r: F.col("page").between(r["a"], r["b"]))
    return elements.withColumn("__range", F.explode(held)).withColumns({"chapter": F.col("__range.chapter"), "span_ord": F.col("__range.span_ord")}).drop("__range")


def in_sections(spans: DataFrame, profile: Profile) -> DataFrame:
    """The elements of each span up to the stop, with their section.

    Figures are left out. The first level-1 heading after any level-2 heading, para or code stops the
    span. The section is the chapter until a level-2 heading matches ``section_re`` (group 1).
    """
    order = Window.partitionBy("doc_id", "span_ord", "chapter").orderBy("ord")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    heading = F.col("kind") == "heading"
    body = ~heading | (F.col("level") == 2)
    rows = spans.filter("kind <> 'figure'").withColumn("__started", F.coalesce(F.bool_or(body).over(before), F.lit(False)))
    rows = rows.withColumn("__stop", F.bool_or(heading & (F.col("level") == 1) & F.col("__started")).over(upto)).filter("not __stop")
    named = F.when(heading & (F.col("level") == 2), match_start(trim_ws(F.col("text")), profile.section_re)) if profile.section_re else F.lit(None).cast("string")
    rows = rows.withColumn("__sec", named)
    return rows.withColumn("section", F.coalesce(F.last("__sec", ignorenulls=True).over(upto), "chapter")).drop("__started", "__stop", "__sec")


def units_of(sectioned: DataFrame) -> DataFrame:
    """Units in order: each run of paras (broken by headings and code) and each code block."""
    keys = ["doc_id", "span_ord", "chapter"]
    run = run_ids(F.col("kind"), "para", Window.partitionBy(*keys).orderBy("ord"))
    units = (
        sectioned.withColumn("__run", run)
        .filter("kind in ('para', 'code')")
        .groupBy(*keys, "__run")
        .agg(
            F.first("section").alias("section"), F.min("ord").alias("unit_ord"), joined(F.collect_list(F.struct("ord", "text"))).alias("text"),
            F.min_by("page", "ord").alias("page"), (F.first("kind") == "code").alias("is_code"),
        )
    )
    return units.drop("__run")


def section_texts(sectioned: DataFrame) -> DataFrame:
    """(doc_id, span_ord, chapter, section, section_text): paras and code joined; a section of headings alone is empty."""
    part = F.when(F.col("kind") != "heading", F.struct("ord", "text"))
    return sectioned.groupBy("doc_id", "span_ord", "chapter", "section").agg(joined(F.collect_list(part)).alias("section_text"))


def with_section_text(units: DataFrame, texts: DataFrame) -> DataFrame:
    """Units with their section's text, empty if there is none."""
    out = units.join(texts, ["doc_id", "span_ord", "chapter", "section"], "left")
    return out.withColumn("section_text", F.coalesce("section_text", F.lit("")))
