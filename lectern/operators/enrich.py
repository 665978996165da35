"""Retrieval metadata for units: prompts, a pluggable extractor, resumable checkpoints.

Checkpoint rows are appended with a sequence number; the last row of a unit holds, at the place of
its first. Failed units keep their text and are tried again on resume.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Any, Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType, _parse_datatype_string

TYPES = ("definition", "rationale", "example", "code", "red_flag")
FIELDS = "principle string, type string, context_line string, applies_when string, key_terms array<string>, questions array<string>"
FIELD_NAMES = [f.split()[0] for f in FIELDS.split(", ")]
LISTS = ("key_terms", "questions")
CHECKPOINT = "doc_id long, digest string, key string, text string, chapter string, section string, page int, enrich_model string, needs_enrich int, " + FIELDS
#: What tells a unit from others, in a checkpoint and a corpus.
IDENTITY = ["doc_id", "chapter", "digest"]
#: What extractors are asked for, as a JSON schema.
SCHEMA: dict[str, Any] = {
    "type": "object", "required": FIELD_NAMES,
    "properties": {n: {"type": "array", "items": {"type": "string"}} if n in LISTS else {"type": "string", "enum": list(TYPES)} if n == "type" else {"type": "string"} for n in FIELD_NAMES},
}
# Fixed values of the context estimate.
CONTEXT_FLOOR, CONTEXT_CAP, CONTEXT_MARGIN, CHARS_PER_TOKEN = 8192, 32768, 2048, 3


@runtime_checkable
class Extractor(Protocol):
    """Gives the fields of a schema for a prompt; has to be picklable."""

    def extract(self, prompt: str, schema: dict[str, Any], *, system: str | None = None) -> dict: ...


class StubExtractor:
    """The same fields for every prompt."""

    model = "stub"

    def __init__(self, payload: dict):
        self.payload = payload

    def extract(self, prompt: str, schema: dict[str, Any], *, system: str | None = None) -> dict:
        return dict(self.payload)


class RuleExtractor:
    """Fields from the passage itself, for where no model is at hand."""

    model = "rules"

    def extract(self, prompt: str, schema: dict[str, Any], *, system: str | None = None) -> dict:
        passage = prompt.rsplit("PASSAGE", 1)[-1].split(":", 1)[-1].strip()
        words = sorted({w.strip(".,;:!?()").lower() for w in passage.split() if len(w) > 5})
        return {"principle": "", "type": "rationale", "context_line": passage[:120], "applies_when": "", "key_terms": words[:8], "questions": []}


def validated(payload: Any) -> dict:
    """The payload's fields, if all are there and of their types; else ValueError, which counts as a failed call."""
    if not isinstance(payload, dict):
        raise ValueError("not an object")
    for name in FIELD_NAMES:
        value = payload.get(name)
        ok = isinstance(value, list) and all(isinstance(x, str) for x in value) if name in LISTS else isinstance(value, str)
        if not ok or (name == "type" and value not in TYPES):
            raise ValueError(f"{name}: {value!r}")
    return {name: payload[name] for name in FIELD_NAMES}


def unit_digest(section: Column, is_code: Column, text: Column) -> Column:
    """SHA-1 of section, kind and whole text."""
    return F.sha1(F.concat(section, F.lit("|"), F.when(is_code, "True").otherwise("False"), F.lit("|"), text))


def unit_key(section: Column, is_code: Column, text: Column) -> Column:
    """The first 12 hexadecimal digits of the digest: the key that is shown. Units are told apart by the whole digest."""
    return F.substring(unit_digest(section, is_code, text), 1, 12)


def render_prompt(template: str, card: Column, section: Column, passage: Column) -> Column:
    """The template with {card}, {section} and {passage} filled in; doubled braces stand for braces.

    The template is taken apart on the driver, so braces in the values stay as they are.
    """
    from string import Formatter

    values = {"card": card, "section": section, "passage": passage}
    parts = []
    for literal, name, spec, conversion in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            if name not in values or spec or conversion:
                raise ValueError(f"unknown placeholder {{{name}}}")
            parts.append(values[name])
    return F.concat(*parts) if parts else F.lit("")


def context_size(prompts: DataFrame, system: str, prompt_col: str = "prompt") -> DataFrame:
    """One row: num_ctx for the longest prompt, within floor and cap, and whether it needs more than the cap."""
    longest = F.max(F.length(prompt_col) + len(system))
    need = F.coalesce(F.floor(longest / CHARS_PER_TOKEN), F.lit(0)) + F.when(longest.isNull(), 0).otherwise(CONTEXT_MARGIN)
    return prompts.agg(need.cast("long").alias("need")).select(
        F.greatest(F.lit(CONTEXT_FLOOR), F.least("need", F.lit(CONTEXT_CAP))).cast("long").alias("num_ctx"), (F.col("need") > CONTEXT_CAP).alias("over_cap")
    )


def done_keys(checkpoint: DataFrame, on: list[str]) -> DataFrame:
    return checkpoint.filter(F.coalesce("needs_enrich", F.lit(0)) == 0).select(*on).distinct()


def pending(units: DataFrame, checkpoint: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Units that no successful row has, by the columns ``on``."""
    on = on or IDENTITY
    return units.join(done_keys(checkpoint, on), on, "left_anti")


def last_wins(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row for each key: the values of the last row, and in ``position`` the place of the first."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), seq).alias("v"), F.min(seq).alias("position"))
    return best.select(*keys, *(F.col(f"v.{c}").alias(c) for c in others), "position")


def checked_type(type_: Column) -> Column:
    """The type, or an error if it is none of TYPES; null passes."""
    return F.when(type_.isNull() | type_.isin(*TYPES), type_).otherwise(F.raise_error(F.concat(F.lit("not a unit type: "), type_)))


def typed(is_code: Column, type_: Column) -> Column:
    """The type of a unit: code units have type code, whatever the extractor says."""
    return F.when(is_code, "code").otherwise(type_)


def enrich_one(extractor: Extractor, prompt: str, is_code: bool, system: str = "", retries: int = 2, back_off: float = 1.0) -> dict:
    """The validated fields of one unit, and needs_enrich.

    A call that fails, or whose answer isn't valid, is made ``retries`` times more after 1, 2, ... times
    ``back_off`` seconds; then the fields stay empty and needs_enrich is 1.
    """
    for attempt in range(retries + 1):
        try:
            return {**validated(extractor.extract(prompt, SCHEMA, system=system)), "needs_enrich": 0}
        except Exception:  # whatever a client raises counts as a failed call
            if attempt < retries:
                time.sleep(back_off * 2**attempt)
    empty = {"principle": "", "type": "code" if is_code else "rationale", "context_line": "", "applies_when": "", "key_terms": [], "questions": []}
    return {**empty, "needs_enrich": 1}


def enrich(units: DataFrame, extractor: Extractor, system: str = "", retries: int = 2, back_off: float = 1.0, workers: int | None = None) -> DataFrame:
    """``units`` (is_code, prompt and other columns, which stay) with their fields, needs_enrich and enrich_model; see ``enrich_one``.

    ``workers`` bounds the calls in flight; without it, every partition has one.
    """
    model = getattr(extractor, "model", "stub")
    schema = StructType([*units.schema.fields, *_parse_datatype_string(FIELDS).fields, StructField("needs_enrich", IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [enrich_one(extractor, p, c, system, retries, back_off) for p, c in zip(pdf["prompt"], pdf["is_code"], strict=True)]
            for name in [*FIELD_NAMES, "needs_enrich"]:
                pdf[name] = [g[name] for g in got]
            yield pdf

    rows = units.repartition(workers) if workers else units
    rows = rows.mapInPandas(run, schema).withColumn("type", typed(F.col("is_code"), F.col("type")))
    return rows.withColumn("enrich_model", F.lit(model)).drop("is_code", "prompt")


def override_principle(rows: DataFrame, topics: DataFrame) -> DataFrame:
    """principle from the chapter's first topic (chapter, ord, principle); empty if there is none or it has none."""
    first = topics.groupBy(F.col("chapter").cast("string").alias("chapter")).agg(F.min_by(F.struct("principle"), "ord")["principle"].alias("__p"))
    return rows.join(first, "chapter", "left").withColumn("principle", F.coalesce("__p", F.lit(""))).drop("__p")


def card(fields: dict[str, Column], slug: Column, name: Column) -> Column:
    """A principle's card: two header lines, then each list that isn't empty under its title."""
    parts = [F.concat(F.lit("principle: "), slug), F.concat(F.lit("name: "), F.coalesce(name, F.lit("")))]
    for title, values in fields.items():
        bullets = F.array_join(F.transform(values, lambda v: F.concat(F.lit("  - "), v)), "\n")
        parts.append(F.when(F.size(values) > 0, F.concat(F.lit(f"{title}:\n"), bullets)))
    return F.concat_ws("\n", *parts)


def with_cards(rows: DataFrame, cards: DataFrame) -> DataFrame:
    """Rows with their principle's card (slug, card): empty without principle, an error for an unknown one."""
    out = rows.join(cards, F.col("principle") == F.col("slug"), "left")
    missing = F.raise_error(F.concat(F.lit("no such principle: "), F.col("principle")))
    return out.withColumn("card", F.when(F.coalesce("principle", F.lit("")) == "", "").when(F.col("slug").isNull(), missing).otherwise(F.col("card"))).drop("slug")


def build_report(rows: DataFrame) -> DataFrame:
    """(chapter, units, failed), and the totals with a null chapter."""
    return rows.rollup("chapter").agg(F.count("*").alias("units"), F.coalesce(F.sum(F.coalesce("needs_enrich", F.lit(0))), F.lit(0)).alias("failed"))
