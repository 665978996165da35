"""The shared tables as inputs of the engine's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.layout import Profile
from lectern.sources.scratch import dealt

#: Lines of documents as spans: words with a digit are set as code, capitalised ones as headings.
LINE_PROFILE = Profile(code_font="Mono", head_font="Head", chapter_size=8.0, figure_min_area=5000)
EVENT_PROFILE = Profile(section_re=r"(\d+\.\d+)", chapter_re=r"Chapter (\d+)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_spans(docs: DataFrame) -> DataFrame:
    """Words as spans. Texts are dealt by document first, so lines are put together where they are and no word is shuffled."""
    lines = dealt(docs.select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    words = lines.select("doc_id", "line", F.posexplode(F.split("l", " ")).alias("span", "w"))
    font = F.when(F.col("w").rlike("[0-9]"), "Mono-Regular").when(F.col("w").rlike("^[A-Z]"), "Head-Bold").otherwise("Serif")
    return words.select(
        "doc_id", F.lit(1).alias("page"), F.lit(0).alias("block"), "line", "span", F.lit(0).alias("block_type"),
        F.concat("w", F.lit(" ")).alias("text"), font.alias("font"), F.length("w").cast("double").alias("size"),
    )


def event_elements(events: DataFrame, kinds: dict[str, tuple[str, int]]) -> DataFrame:
    """Events of a user, in order of time, as elements. kinds: event type -> (kind, level); others are paras."""
    kind, level = F.lit("para"), F.lit(0)
    for name, (k, n) in kinds.items():
        kind, level = F.when(F.col("event_type") == name, k).otherwise(kind), F.when(F.col("event_type") == name, n).otherwise(level)
    text = F.when(F.col("event_type") == "signup", F.concat(F.lit("Chapter "), F.col("event_id").cast("string")))
    text = text.when(F.col("event_type") == "error", F.concat((F.col("event_id") % 7).cast("string"), F.lit("."), (F.col("event_id") % 5).cast("string")))
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return events.select(
        F.col("user_id").alias("doc_id"), order.alias("ord"), kind.alias("kind"), text.otherwise(F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"))).alias("text"),
        (F.col("event_id") % 100).cast("int").alias("page"), level.alias("level"),
    )


def whole_spans(elements: DataFrame) -> DataFrame:
    """Each document as one span, with its id as chapter."""
    return elements.withColumn("chapter", F.col("doc_id").cast("string")).withColumn("span_ord", F.lit(1).cast("long"))


def document_units(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("section"), F.col("source").alias("principle"), "n_chars")
