"""Intermediate tables in the folder that all executors share, named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, or a temporary folder in a local session without one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lectern-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many parts as the session has cores, if it comes in fewer (small files, of one row group)."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` by ``key`` in as many parts as a shuffle or ``df`` itself has, whichever is more: what is then grouped by the key is not shuffled again."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    return df.repartition(n, key)


def scratch(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written once to the shared folder and read back: its plan is cut, and it outlives lost executors. A folder for each value of ``by``."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
