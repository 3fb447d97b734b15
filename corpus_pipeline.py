"""A corpus pipeline over ``documents``: toxicity, near-duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm import decontaminate, mixing, near_duplicates, token_output, toxicity
from vertexloom.llm.common import materialize, table

#: SQL can't express the trained and the hashed stages; tests hold them against plain Python.
ORACLE_SQL = None
TOXIC_FROM = 0.3
#: Few, as Spark reuses Python workers and they go on holding them in other stages.
KEPT_PIECES = 100_000


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a score of at least ``TOXIC_FROM`` go."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    scored = toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels"), held_out, with_row=True)
    return scored.where(F.col("score") < TOXIC_FROM).select("row.*")


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id stays of each group, on shingles of five words. Rows that
    repeat an id and its text count once."""
    return near_duplicates.without_near_duplicates(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the benchmark makes up a twentieth or more go."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), with_row=True)
    return found.where(~decontaminate.is_contaminated()).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes."""
    return mixing.mixed_documents(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in ORC files; what they hold of each document."""
    return token_output.token_ids_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), kept_pieces=KEPT_PIECES)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", decontaminate_documents),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
