"""Hits as JSON and as citations."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_MATCHES = "(no matches)"


def citation(principle: str = "principle", section: str = "section", page: str = "page", type_: str = "type", text: str = "text") -> Column:
    return F.concat(
        F.lit("["), F.col(principle), F.lit(" §"), F.col(section), F.lit(" p."), F.col(page).cast("string"), F.lit("] ("), F.col(type_), F.lit(")\n"), F.col(text), F.lit("\n")
    )


def json_rows(hits: DataFrame) -> DataFrame:
    """Each hit as one JSON object."""
    return hits.select(F.to_json(F.struct(*hits.columns)).alias("json"))


def render_json(hits: DataFrame) -> str:
    """A handful of hits as an indented, ASCII-escaped JSON list."""
    return json.dumps([r.asDict() for r in hits.collect()], indent=2)


def render_text(hits: DataFrame) -> str:
    rows = hits.orderBy("score", "id").select(citation().alias("c")).collect()
    return "\n".join(r.c for r in rows) if rows else NO_MATCHES
