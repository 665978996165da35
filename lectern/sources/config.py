"""Instance files: profile, taxonomy, evaluation cases and prompt, read on the driver with fixed schemas."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from lectern.operators.evaluate import CASES
from lectern.operators.layout import Profile

SYSTEM_MARK, TEMPLATE_MARK = "<!-- SYSTEM -->", "<!-- TEMPLATE -->"
PRINCIPLES = "slug string, name string, vocabulary array<string>, diagnostics array<string>, red_flags array<string>"
TOPICS = "ord int, chapter string, title string, principle string"


@dataclass(frozen=True)
class Prompt:
    system: str
    template: str


def load_profile(path: str | Path) -> Profile:
    """A profile from YAML; page ranges are lists of two numbers. Unknown keys are errors."""
    raw = yaml.safe_load(Path(path).read_text()) or {}
    if unknown := set(raw) - {f.name for f in fields(Profile)}:
        raise ValueError(f"not in a profile: {sorted(unknown)}")
    for name in ("chapter_pages", "appendices"):
        raw[name] = {str(k): (int(a), int(b)) for k, (a, b) in (raw.get(name) or {}).items()}
    return Profile(**raw)


def load_prompt(path: str | Path) -> Prompt:
    """System text and template, parted by the first template mark; without the mark it is an error."""
    system, mark, template = Path(path).read_text().partition(TEMPLATE_MARK)
    if not mark:
        raise ValueError(f"{path} has no {TEMPLATE_MARK}")
    return Prompt(system.replace(SYSTEM_MARK, "").strip(), template.strip())


def load_taxonomy(spark: SparkSession, path: str | Path) -> tuple[DataFrame, DataFrame]:
    """(principles, topics) as small tables; topics keep their order, chapters are strings."""
    raw = yaml.safe_load(Path(path).read_text()) or {}
    principles = [(p.get("slug"), p.get("name") or "", *(p.get(f) or [] for f in ("vocabulary", "diagnostics", "red_flags"))) for p in raw.get("principles") or []]
    topics = [(i, str(t.get("chapter")), t.get("title"), t.get("principle")) for i, t in enumerate(raw.get("topics") or [])]
    return spark.createDataFrame(principles, PRINCIPLES), spark.createDataFrame(topics, TOPICS)


def load_cases(spark: SparkSession, path: str | Path) -> DataFrame:
    raw = yaml.safe_load(Path(path).read_text())["cases"]
    return spark.createDataFrame([(i, c["query"], c.get("expect_principle"), c.get("expect_section")) for i, c in enumerate(raw)], CASES)
