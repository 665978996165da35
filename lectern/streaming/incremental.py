"""Micro-batches over a folder of units: enrich what is new, index what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators import enrich as en
from lectern.operators.index import build_index
from lectern.operators.living_index import LivingIndex
from lectern.sources.checkpoints import read_checkpoint, write_checkpoint

PENDING = "doc_id long, digest string, key string, text string, chapter string, section string, page int, is_code boolean, prompt string, seq long"


def enrich_stream(spark: SparkSession, source: str, checkpoint: str, state: str, extractor: en.Extractor, system: str = "") -> StreamingQuery:
    """Enriches units (PENDING, Parquet) as they arrive in ``source``; units that succeeded before are skipped.

    ``state`` is the stream's own checkpoint. A batch that is run again is in the manifest already, or nothing of it is read.
    """

    def step(units: DataFrame, batch: int) -> None:
        todo = en.pending(units.dropDuplicates(en.IDENTITY), read_checkpoint(spark, checkpoint))
        write_checkpoint(en.enrich(todo, extractor, system).withColumn("attempt", F.lit(batch).cast("int")), checkpoint, f"stream-{batch}")

    units = spark.readStream.schema(PENDING).parquet(source)
    return units.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start()


def upsert_stream(spark: SparkSession, source: str, schema: str, index: LivingIndex, state: str) -> StreamingQuery:
    """Writes new and changed units to an index as they arrive, one segment for each batch; of a unit that comes twice in a batch, the row of greatest ``version`` holds.

    A batch that is run again has a number that the index knows, and does nothing.
    """

    def step(units: DataFrame, batch: int) -> None:
        last = units.groupBy("id").agg(F.max_by(F.struct(*index.columns), "version").alias("u")).select("id", "u.*")
        index.write(last, token=batch)

    units = spark.readStream.schema(schema).parquet(source)
    return units.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start()


def index_stream(spark: SparkSession, source: str, schema: str, columns: list[str], path: str, state: str) -> StreamingQuery:
    """Adds postings and lengths of new units to an index, one part for each batch.

    A part is written over if its batch is run again. Units are only added, never changed.
    """

    def step(units: DataFrame, batch: int) -> None:
        index = build_index(units, columns)
        index.postings.sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings/batch={batch}")
        index.lengths.write.mode("overwrite").parquet(f"{path}/lengths/batch={batch}")

    units = spark.readStream.schema(schema).parquet(source)
    return units.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start()
