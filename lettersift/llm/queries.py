"""The registered queries of this subpackage: thin calls with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lettersift.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lettersift.llm.urls import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lettersift.llm.langid import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lettersift.llm.rules import adaptive_rules

    return adaptive_rules(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lettersift.llm.gam import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lettersift.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lettersift.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"), shards=8)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lettersift.llm.decontam import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lettersift.llm.substrings import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"), texts=False)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lettersift.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    from lettersift.llm import decontam, rules, substrings, urls

    return {"op2_url_filter": urls.oracle(), "op4_quality_rules": rules.oracle(), "op8_decontamination": decontam.SQL, "op9_substring_dedup": substrings.SQL}
