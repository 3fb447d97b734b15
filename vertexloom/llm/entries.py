"""The operators' queries over the tables of a directory, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, mixing, near_duplicates, quality, sharding, token_count, token_output, topk, toxicity
from .common import table


#: Small shards, so that even small tables split over several levels.
SHARDS = sharding.ShardSettings(limit_bytes=128 << 10)


def _fold(modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus, F.lit(-1))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), near_duplicates.NearDuplicateSettings(shingle_words=4))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=_fold(5) == 0, calibrates=_fold(5) == 1)
    return scores.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_ids_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), SHARDS)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=_fold(4) == 2)
    return scores.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"), held_out=_fold(5) == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_duplicates": op1_near_duplicates,
        "op2_token_counts": op2_token_counts,
        "op3_top_k": op3_top_k,
        "op4_quality": op4_quality,
        "op5_token_ids": op5_token_ids,
        "op6_decontaminate": op6_decontaminate,
        "op7_sharding": op7_sharding,
        "op8_toxicity": op8_toxicity,
        "op9_mixing": op9_mixing,
        "op10_language": op10_language,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_duplicates": near_duplicates.ORACLE,
        "op3_top_k": topk.ORACLE,
        "op6_decontaminate": decontaminate.ORACLE,
        "op7_sharding": sharding.ORACLE.format(limit=SHARDS.limit_bytes),
        "op9_mixing": mixing.ORACLE,
    }
