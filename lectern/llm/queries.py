"""One query for each training-data operator: the operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.chat import format_chats, read_chats
from lectern.llm.decontaminate import contamination
from lectern.llm.filter_audit import audit_filters
from lectern.llm.hmm_scores import score_texts
from lectern.llm.line_dedup import drop_spread_lines
from lectern.llm.merkle import folded, leaf_digest, manifest, proof_digest
from lectern.llm.mixing import mix_taken
from lectern.llm.near_dups import near_duplicates
from lectern.llm.packing import pack_documents
from lectern.llm.quality_lines import judge_quality
from lectern.llm.secret_scan import scan_secrets
from lectern.llm.sharding import minimax_shards
from lectern.llm.sql import ORACLE  # noqa: F401
from lectern.llm.substring_dedup import drop_repeats


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


def op3_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards(_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, "contaminated")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_taken(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_spread_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_drop_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(_table(spark, sf_dir, "documents"), texts=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = read_chats(format_chats(turns))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op11_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # the files of the tokenizers, where they are installed

    out = pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    leaf = leaf_digest([*fields, F.col("text")]).alias("digest")
    leaves = docs.select("doc_id", "lang", leaf, F.when(touched, leaf_digest([*fields, lowered])).alias("tampered"))
    out = manifest(leaves, "lang", "doc_id").withColumn("folded_root", folded(F.coalesce("tampered", "digest"), F.col("proof")))
    return out.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_near_dups, op2_hmm_scores, op3_quality_lines, op4_minimax_shards, op5_decontaminate,
        op6_mix_sources, op7_line_dedup, op8_drop_repeats, op9_format_chats, op10_secret_scan,
        op11_pack_sequences, op12_merkle_manifest, op13_filter_audit,
    )
}
