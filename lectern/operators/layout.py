"""Laid-out text to ordered structural elements.

Input: spans, one row each, keyed by (doc_id, page, block, line, span); pages count from 1. Everything
is partitioned by document; positions are columns, never row order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import joined, rtrim_ws, trim_ws

SPANS = (
    "doc_id long, page int, block int, line int, span int, block_type int, x0 double, y0 double, x1 double, y1 double, text string, font string, size double"
)
TREE = (
    "doc_id long, pages array<struct<page int, blocks array<struct<type int, bbox array<double>, "
    "lines array<struct<spans array<struct<text string, font string, size double>>>>>>>>"
)
ELEMENTS = "doc_id long, ord long, kind string, text string, page int, level int"
HEAD_SHARE = 0.6


@dataclass(frozen=True)
class Profile:
    """How a corpus is laid out. Page ranges: id -> (first page, last page), both included."""

    code_font: str = ""
    head_font: str = ""
    chapter_size: float = 0.0
    figure_min_area: int = 0
    section_re: str = ""
    chapter_re: str = ""
    chapter_pages: dict[str, tuple[int, int]] = field(default_factory=dict)
    appendices: dict[str, tuple[int, int]] = field(default_factory=dict)


def flatten_layout(tree: DataFrame) -> DataFrame:
    """A layout tree as spans; image blocks give one row without text."""
    blocks = tree.select("doc_id", F.explode("pages").alias("p")).select("doc_id", F.col("p.page").alias("page"), F.posexplode("p.blocks").alias("block", "b"))
    lines = blocks.select("doc_id", "page", "block", "b", F.posexplode_outer("b.lines").alias("line", "l"))
    spans = lines.select("doc_id", "page", "block", "b", F.coalesce("line", F.lit(0)).alias("line"), F.posexplode_outer("l.spans").alias("span", "s"))
    spans = spans.filter((F.col("b.type") == 1) | F.col("s").isNotNull())
    box = [F.col("b.bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    span = F.coalesce("span", F.lit(0)).alias("span")
    return spans.select("doc_id", "page", "block", "line", span, F.col("b.type").alias("block_type"), *box, "s.text", "s.font", "s.size")


def page_range(df: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Pages first to last; None and 0 leave an end open, and ends beyond the document do no harm."""
    df = df.filter(F.col("page") >= max(1, first or 1))
    return df.filter(F.col("page") <= last) if last else df


def font_class(font: Column, profile: Profile) -> Column:
    """code, head or body by parts of the font's name; code wins."""
    return F.when(font.contains(profile.code_font), "code").when(font.contains(profile.head_font), "head").otherwise("body")


def is_solid(text: Column) -> Column:
    """Whether there is more than white space."""
    return F.length(trim_ws(text)) > 0


def class_lines(spans: DataFrame, profile: Profile) -> DataFrame:
    """Lines of text blocks: kind, level and text. Lines of blank spans alone are left out.

    A line is a heading if at least 0.6 of its non-blank spans are set in the heading font (of level 1
    from the chapter size on, else 2), code if all of them are code, else para.
    """
    solid = is_solid(F.col("text"))
    cls = font_class(F.col("font"), profile)
    lines = (
        spans.filter("block_type <> 1")
        .groupBy("doc_id", "page", "block", "line")
        .agg(
            joined(F.collect_list(F.struct("span", "text")), "").alias("text"),
            F.avg(F.when(solid, (cls == "head").cast("double"))).alias("head_share"),
            F.max(F.when(solid, F.col("size"))).alias("max_size"),
            F.bool_and(F.when(solid, cls == "code")).alias("all_code"),
        )
        .filter("head_share is not null")
    )
    kind = F.when(F.col("head_share") >= HEAD_SHARE, "heading").when(F.col("all_code"), "code").otherwise("para")
    level = F.when(F.col("kind") == "heading", F.when(F.col("max_size") >= profile.chapter_size, 1).otherwise(2)).otherwise(0)
    lines = lines.withColumn("kind", kind).withColumn("level", level)
    text = F.when(F.col("kind") == "code", rtrim_ws(F.col("text"))).otherwise(trim_ws(F.col("text")))
    return lines.select("doc_id", "page", "block", "line", "kind", text.alias("text"), "level")


def figures(spans: DataFrame, profile: Profile) -> DataFrame:
    """Placeholders of image blocks of the least area or more; smaller ones vanish."""
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    big = spans.filter("block_type = 1").filter(width * height >= profile.figure_min_area)
    name = F.format_string("[FIGURE %dx%d]", width.cast("int"), height.cast("int"))
    return big.select("doc_id", "page", "block", "line", F.lit("figure").alias("kind"), name.alias("text"), F.lit(0).alias("level"))


def run_ids(kind: Column, runs_of: str, over: Window) -> Column:
    """A number for each run of rows of one kind; rows of other kinds stand alone."""
    breaks = (kind != runs_of) | F.coalesce(F.lag(kind).over(over) != runs_of, F.lit(True))
    return F.sum(breaks.cast("int")).over(over.rowsBetween(Window.unboundedPreceding, 0))


def elements_of(spans: DataFrame, profile: Profile) -> DataFrame:
    """Ordered elements: headings, paras, figures, and code lines joined as long as nothing else comes between."""
    rows = class_lines(spans, profile).unionByName(figures(spans, profile))
    order = Window.partitionBy("doc_id").orderBy("page", "block", "line")
    rows = rows.withColumn("ord", F.row_number().over(order).cast("long"))
    return join_runs(rows, "code", ["doc_id"])


def join_runs(rows: DataFrame, runs_of: str, keys: list[str]) -> DataFrame:
    """Rows (keys, ord, kind, text, page, level) with each run of one kind as one row: texts joined, the first one's place."""
    run = run_ids(F.col("kind"), runs_of, Window.partitionBy(*keys).orderBy("ord"))
    return (
        rows.withColumn("run", run)
        .groupBy(*keys, "run")
        .agg(
            F.min("ord").alias("ord"), F.first("kind").alias("kind"), joined(F.collect_list(F.struct("ord", "text"))).alias("text"),
            F.min_by("page", "ord").alias("page"), F.max("level").alias("level"),
        )
        .drop("run")
    )
