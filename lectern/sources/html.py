"""Web pages as ordered rows: one for each tag, with the text that follows it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import trim_ws

LEVELS = {"title": 1, "h1": 1, "h2": 2, "h3": 2}
TAGS = ("title", "h1", "h2", "h3", "p", "li")
#: Tags that end a list item (all end tags but ``</li>`` are those of what holds it), and those it may hold; both end any other element.
AROUND = ("article", "aside", "body", "footer", "head", "header", "html", "main", "menu", "nav", "ol", "section", "ul")
INSIDE = (
    "address", "blockquote", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "form", "h4", "h5", "h6", "hr", "pre", "summary",
    "table", "caption", "tbody", "td", "tfoot", "th", "thead", "tr",
)
#: Their content is no text.
RAW = ("script", "style")


def html_rows(pages: DataFrame) -> DataFrame:
    """(page_id, pos, chunk): pages cut before every ``<``; positions count from 0."""
    return pages.select("page_id", F.posexplode(F.split("html", "<")).alias("pos", "chunk"))


def html_elements(pages: DataFrame) -> DataFrame:
    """(page_id, pos, kind, level, text) of titles, headings, paragraphs and list items with text.

    The text goes on over inline tags, up to the element's end tag or the next tag of a block; ``<br>`` and
    blocks inside a list item start a line. After another element, an outer one doesn't go on.
    """
    upto = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    tag, name = F.col("tag"), F.ltrim(F.col("tag"), F.lit("/"))
    last = lambda when, value: F.last(F.when(when, value), ignorenulls=True).over(upto)
    rows = html_rows(pages).withColumn("tag", F.regexp_extract("chunk", "^(/?[a-z][a-z0-9]*)[^>]*>", 1))
    rows = rows.withColumn("raw", last(name.isin(*RAW), tag.isin(*RAW))).filter(~F.coalesce("raw", F.lit(False)))
    rows = rows.withColumn("start", last(tag.isin(*TAGS), F.col("pos"))).withColumn("of", last(tag.isin(*TAGS), tag))
    ends = (tag == F.concat(F.lit("/"), "of")) | name.isin(*AROUND) | ((F.col("of") != "li") & name.isin(*INSIDE, *TAGS) & (F.col("pos") > F.col("start")))
    rows = rows.withColumn("ended", F.coalesce(last(ends, F.col("pos")), F.lit(-1))).filter("ended < start")
    # '<' before anything but a tag is a character of the text
    text = F.when(F.col("chunk").rlike("^[a-zA-Z/!?]"), F.regexp_replace("chunk", "^[^>]*(>|$)", "")).otherwise(F.concat(F.lit("<"), "chunk"))
    piece = F.concat(F.when((tag == "br") | name.isin(*INSIDE, *TAGS), "\n").otherwise(""), text)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))), lambda x: x["piece"]), "")
    rows = rows.groupBy("page_id", F.col("start").alias("pos"), "of").agg(trim_ws(joined).alias("text"))
    level = F.coalesce(F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv))[F.col("of")], F.lit(0))
    return rows.select("page_id", "pos", F.when(level > 0, "heading").otherwise("para").alias("kind"), level.alias("level"), "text").filter("text <> ''")
