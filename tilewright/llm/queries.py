"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import contamination, fim, language, licenses, packing, pages, passages, periodic, preferences, quality, secrets, sharding, simhash
from tilewright.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("text_hash")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_text(table(spark, sf_dir, "pages"))


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.format_preferences(preferences.contrasted(table(spark, sf_dir, "conversations")))


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.with_planted_repeats(table(spark, sf_dir, "documents")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_digests(table(spark, sf_dir, "documents"))


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.strip_repeats(table(spark, sf_dir, "documents")).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: value for name, value in globals().items() if name.startswith("op") and callable(value)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.license_sql(), "op12_fill_in_middle": fim.fim_sql(), "op13_repeated_passages": passages.repeats_sql()}
