"""Checkpoint rows as JSON lines, a folder for each batch and in it for each chapter. A manifest names the batches that are whole.

A batch is there once its manifest is: files of a write that broke off, or was made twice, are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.enrich import CHECKPOINT
from lectern.sources.manifest import Manifest

ROWS = CHECKPOINT.replace("chapter string, ", "") + ", seq long, attempt int, chapter string"
COLUMNS = [c.split()[0] for c in ROWS.split(", ")]


def _folder(path: str, batch: str) -> str:
    return f"{path.rstrip('/')}/batch={batch}"


def _write(rows: DataFrame, path: str) -> str:
    """Rows in a folder of their own, whose name it gives; nobody reads it yet."""
    folder = uuid.uuid4().hex
    rows.select(*COLUMNS).write.partitionBy("chapter").json(_folder(path, folder))
    return folder


def write_checkpoint(rows: DataFrame, path: str, name: str | None = None) -> None:
    """Adds rows (CHECKPOINT, seq, attempt) as a batch. One whose ``name`` is there already has been written before and isn't again."""
    manifest = Manifest(rows.sparkSession, path)
    version, state = manifest.read()
    batches = state.get("batches", [])
    if name is not None and any(b["name"] == name for b in batches):
        return
    folder = _write(rows, path)
    manifest.commit(version, {"batches": [*batches, {"name": name or folder, "folder": folder}]})


def start_anew(chapters: DataFrame, path: str) -> None:
    """Drops what the checkpoint holds of ``chapters`` (chapter); other chapters stay, as one batch."""
    spark = chapters.sparkSession
    manifest = Manifest(spark, path)
    version, state = manifest.read()
    if not state.get("batches"):
        return
    others = read_checkpoint(spark, path).join(chapters.select("chapter").distinct(), "chapter", "left_anti")
    folder = _write(others, path) if others.limit(1).count() else None
    manifest.commit(version, {"batches": [{"name": folder, "folder": folder}] if folder else []})


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """All rows of whole batches; none if there is no checkpoint. Blank lines are skipped."""
    folders = [_folder(path, b["folder"]) for b in Manifest(spark, path).read()[1].get("batches", [])]
    if not folders:
        return spark.createDataFrame([], ROWS)
    rows = spark.read.schema(f"{ROWS}, batch string").option("basePath", path).json(folders)
    return rows.filter(F.col("key").isNotNull()).drop("batch")
