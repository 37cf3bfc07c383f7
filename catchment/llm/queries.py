"""One registered query per operator, each over its whole table, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catchment.llm import arc_warc, compact_windows, language, mixing, packing, page_crf, periodic_runs, quality_trees, resampling, secret_index, subspace_join, suffix_pieces, superminhash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query
def op4_superminhash(spark: SparkSession, d: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, d, "documents"))


ORACLES["op4_superminhash"] = superminhash.near_duplicates_sql()


@query
def op10_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"))


ORACLES["op10_mixing"] = mixing.mixing_sql()


@query
def op7_language(spark: SparkSession, d: str) -> DataFrame:
    return language.identify_languages(table(spark, d, "documents"))


@query
def op3_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secret_index.find_secrets(table(spark, d, "documents")).drop("found")


@query
def op1_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality_trees.judge_quality(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op2_page_text(spark: SparkSession, d: str) -> DataFrame:
    return page_crf.extract_text(table(spark, d, "pages"))


@query
def op6_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    return suffix_pieces.encode_texts(table(spark, d, "documents"))


@query
def op5_subspace_join(spark: SparkSession, d: str) -> DataFrame:
    return subspace_join.link_embeddings(table(spark, d, "embeddings"))


@query
def op8_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"))


@query
def op9_compact_windows(spark: SparkSession, d: str) -> DataFrame:
    return compact_windows.repeated_passages(table(spark, d, "documents"))


@query
def op11_resampling(spark: SparkSession, d: str) -> DataFrame:
    return resampling.resample(table(spark, d, "documents"), table(spark, d, "benchmark"))


ORACLES["op11_resampling"] = resampling.resampling_sql()


@query
def op12_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    return periodic_runs.find_runs(table(spark, d, "documents"), written=True)


@query
def op13_arc_warc(spark: SparkSession, d: str) -> DataFrame:
    return arc_warc.archive_pages(table(spark, d, "pages"))


ORACLES["op13_arc_warc"] = arc_warc.archive_sql()
