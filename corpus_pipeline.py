"""A corpus prepared for training: STAGES in order, each on all its predecessor kept.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns of
``documents``; ``run`` writes each result to the shared folder, reads it back and removes the one before.
Rows without an id are judged by their texts alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchment.llm import language, mixing, secret_index, suffix_pieces, superminhash
from catchment.session import fresh_path, remove_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what language identification rejects: texts without a letter or far from all learned languages.

    Rows that repeat an id stand or fall each by its own text.
    """
    return language.keep_known(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, the one with the smallest id, whether ids are repeated, missing or neither.

    Texts without words are in no group and stay.
    """
    return superminhash.first_of_groups(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by their kind, and n_chars follows."""
    masked = secret_index.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as the mix takes them; those it doesn't take go.

    The document at the edge of a source's target stays whole if the mix takes half of it or more.
    Documents without words are no one's share and stay once.
    """
    return mixing.repeat_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with a check that they decode to its text."""
    return suffix_pieces.encode_texts(docs)


STAGES = [
    ("language", known_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Training, signatures and encoding are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # nothing reads the rows of the stage before any more
            remove_path(spark, before)
        before = path
    return docs
