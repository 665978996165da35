"""Stashes in the shared folder, stable row ids and other plumbing of the training-data operators.

Intermediate tables are written to the folder that the cluster names in ``spark.checkpoint.dir``,
so a lost executor costs a task, never a table.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
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


class Stash:
    """A table written once to the shared folder; ``df`` reads it back."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only for tables that no returned DataFrame reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(conf).delete(path, True)


def text_of(column: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def rows_fit(df: DataFrame, bound: int) -> bool:
    """Whether df has at most ``bound`` rows: the check that goes before every broadcast."""
    return df.limit(bound + 1).count() <= bound


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that no one holds any more, after their result is stashed."""
    gc.collect()
    spark._jvm.System.gc()


#: Keys of rows to leave out are broadcast up to this number (some 32 MB), else joined by shuffle.
BROADCAST_KEYS = 1_000_000


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """128 bits of hash of id and text: equal rows share them, so rows can be found again whatever their ids."""
    row = F.col(id_col).cast("string"), F.col(id_col).isNull(), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.struct(*(F.xxhash64(F.lit(salt), *row).alias(name) for name, salt in (("a", 1), ("b", 2))))


def without(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """``docs`` without the rows whose key is in ``gone`` (key). Their texts are not shuffled if ``gone`` is small."""
    gone = Stash(gone.select(F.col("key").alias("__gone")).distinct(), "gone").df
    gone = F.broadcast(gone) if rows_fit(gone, BROADCAST_KEYS) else gone
    return docs.join(gone, key == gone["__gone"], "left_anti")


#: Copies of the smaller side of a salted join.
SALTS = 16


def salted(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left joined to right (distinct in ``on``) by shuffle, each key dealt over SALTS places by a hash of left's rows."""
    spread = F.pmod(F.xxhash64(*(c for c in left.columns if c not in on)), F.lit(SALTS)).cast("int")
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("__salt", spread).join(copies, [*on, "__salt"], how).drop("__salt")
