"""The queries of this subpackage: thin digests of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    binary_output,
    chat_rotation,
    decontaminate,
    language_id,
    near_dedup,
    nearest_neighbours,
    quality_classifier,
    retrieval_packing,
    sharding,
    suffix_dedup,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, n: int):
    """crc32 of an id, as text, modulo ``n``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.drop("text")


def op2_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.digest(chat_rotation.rotate(table(spark, sf_dir, "conversations")))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return found.select(F.col("id").alias("doc_id"), "class_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.report(docs, table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    model = quality_classifier.fit(docs, labels)
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    found = quality_classifier.score(docs, model).drop("text")
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(suffix_dedup.repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    profiles = language_id.fit(docs, where=~held)
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    return language_id.identify(rows, profiles).drop("text")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_output.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_sharding,
        op2_chat_rotation,
        op3_near_dedup,
        op4_decontaminate,
        op5_quality,
        op6_retrieval_packing,
        op7_suffix_dedup,
        op8_language_id,
        op9_nearest_neighbours,
        op10_binary_output,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_sharding": sharding.ORACLE_SQL,
        "op2_chat_rotation": chat_rotation.ORACLE_SQL,
        "op4_decontaminate": decontaminate.ORACLE_SQL,
    }
