"""The inverted index as DataFrames: postings (term, id, dl, one count a column), lengths (id, dl), corpus (n_docs, avgdl), and the terms in order."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.stem import stems
from lectern.functions.text import fold, index_tokens, raw_tokens
from lectern.sources.scratch import dealt, scratch

POSTINGS = "term string, id long, dl long, tf array<long>"
LENGTHS = "id long, dl long"
#: Blocks of the vocabulary: terms of one lead, in order, between the fences first and last.
VOCABULARY = "lead string, first string, last string, terms array<struct<term:string,df:long>>"
#: Characters of a term that make its lead; terms in a block at most.
LEAD, BLOCK_TERMS = 3, 256


def vocabulary_blocks(terms: DataFrame) -> DataFrame:
    """VOCABULARY of (term, df). Ranges of the order are cut into blocks side by side."""
    ranged = terms.select("term", F.col("df").cast("long").alias("df")).repartitionByRange("term").withColumn("__part", F.spark_partition_id())
    ranged = ranged.withColumn("lead", F.substring("term", 1, LEAD))
    nth = F.row_number().over(Window.partitionBy("__part", "lead").orderBy("term"))
    blocks = ranged.withColumn("__block", F.floor((nth - 1) / BLOCK_TERMS)).groupBy("__part", "lead", "__block").agg(F.sort_array(F.collect_list(F.struct("term", "df"))).alias("terms"))
    return blocks.select("lead", F.element_at("terms", 1)["term"].alias("first"), F.element_at("terms", -1)["term"].alias("last"), "terms")


@dataclass
class Index:
    postings: DataFrame  # term, id, dl, tf (array of counts, one for each of columns)
    lengths: DataFrame  # id, dl: tokens over all columns; postings repeat it, so that ranking joins nothing
    columns: list[str]
    stemmed: bool
    known_size: tuple[int, float] | None = None  # n_docs and avgdl, where they are kept
    known_blocks: DataFrame | None = None  # VOCABULARY, where it is saved

    def corpus(self) -> DataFrame:
        """One row: n_docs, avgdl."""
        return self.lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))

    @cached_property
    def size(self) -> tuple[int, float]:
        """n_docs and avgdl, read once for all queries of this index."""
        n_docs, avgdl = self.known_size or self.corpus().first()
        return n_docs, avgdl or 0.0

    def vocabulary(self) -> DataFrame:
        """term, df."""
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))

    @cached_property
    def blocks(self) -> DataFrame:
        """The vocabulary in blocks, made once for all queries of this index."""
        return self.known_blocks if self.known_blocks is not None else scratch(vocabulary_blocks(self.vocabulary()), "vocabulary")

    def save(self, path: str) -> None:
        """Postings in order of term, so that a query's terms prune files and row groups, with lengths, their sums and the vocabulary."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        spark = self.postings.sparkSession
        saved = spark.read.schema(POSTINGS).parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("df"))
        vocabulary_blocks(saved).repartitionByRange("first").sortWithinPartitions("first").write.mode("overwrite").parquet(f"{path}/vocabulary")
        spark.read.schema(LENGTHS).parquet(f"{path}/lengths").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{path}/size")

    @classmethod
    def load(cls, spark: SparkSession, path: str, columns: list[str], stemmed: bool) -> Index:
        """A saved index. One that grew by parts has neither vocabulary nor size; they are then made from its postings and lengths."""
        postings, lengths = spark.read.schema(POSTINGS).parquet(f"{path}/postings"), spark.read.schema(LENGTHS).parquet(f"{path}/lengths")
        if not _is_there(spark, f"{path}/size"):
            return cls(postings, lengths, columns, stemmed)
        n_docs, avgdl = spark.read.schema("n_docs long, avgdl double").parquet(f"{path}/size").first()
        return cls(postings, lengths, columns, stemmed, (n_docs, avgdl or 0.0), spark.read.schema(VOCABULARY).parquet(f"{path}/vocabulary"))


def _is_there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def build_index(units: DataFrame, columns: list[str], stemmed: bool = True) -> Index:
    """Index of the text columns of ``units`` (id and columns). Arrays are indexed as their joined values.

    Texts are dealt by id, so a row's tokens are counted where it is and no token is shuffled, then cut once: the counts by
    token and row are written to the shared folder, and terms, postings and lengths come from them. Stems are found
    once for each distinct token and joined back. A row without tokens has a length of 0.
    """
    units = dealt(units, "id")
    kinds = dict(units.dtypes)
    text = {c: F.array_join(c, " ") if kinds[c].startswith("array") else F.col(c) for c in columns}
    cut = raw_tokens if stemmed else index_tokens

    def placed(column: Column, at: int) -> Column:
        return F.transform(cut(column), lambda t: F.struct(t.alias("token"), F.lit(at).alias("at")))

    tokens = cut(text[columns[0]]) if len(columns) == 1 else F.concat(*(placed(text[c], i) for i, c in enumerate(columns)))
    found = units.select("id", tokens.alias("t")).select("id", F.size("t").cast("long").alias("dl"), F.explode_outer("t").alias("x"))
    found = found.select("id", "dl", F.col("x").alias("token"), F.lit(0).alias("at")) if len(columns) == 1 else found.select("id", "dl", "x.token", "x.at")
    one = F.when(F.col("token").isNotNull(), 1)
    tf = F.array(*(F.count(F.when(F.col("at") == i, one)) for i in range(len(columns))))
    counts = scratch(found.groupBy("token", "id", "dl").agg(tf.alias("tf")), "counts")
    lengths = scratch(counts.groupBy("id").agg(F.first("dl").alias("dl")), "lengths")
    counts = counts.filter("token is not null")
    if not stemmed:
        return Index(counts.select(F.col("token").alias("term"), "id", "dl", "tf"), lengths, columns, stemmed)
    # in as many tasks as a shuffle has, since few tokens take long to stem
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    terms = counts.select("token").distinct().repartition(tasks).withColumn("term", stems(fold(F.col("token"))))
    sums = F.array(*(F.sum(F.col("tf")[i]) for i in range(len(columns))))
    return Index(scratch(counts.join(terms, "token").groupBy("term", "id", "dl").agg(sums.alias("tf")), "postings"), lengths, columns, stemmed)


def compact_index(spark: SparkSession, path: str, to: str, columns: list[str], stemmed: bool) -> None:
    """The index at ``path``, which grew by parts, as one at ``to``: postings in order of term over all parts."""
    Index.load(spark, path, columns, stemmed).save(to)
