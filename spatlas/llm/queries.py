"""Registered queries of this subpackage: thin wrappers that give each operator its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatlas.llm import ngram_join as join
from spatlas.llm import license_scan, mixing, quality_rules, token_counts, warc, winnowing
from spatlas.llm.line_templates import line_dedup
from spatlas.llm.pii import find_pii
from spatlas.llm.suffix_dedup import suffix_dedup
from spatlas.storage import shared_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path, min_revisit_bytes=0)
    return warc.page_records(warc.salvage_archives(spark, path, f"{path}-gaps", with_payload=False))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=5, depth=3, constant_share=0.7)
    kept = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return found.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"), length=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = join.ngram_join(table(spark, sf_dir, "documents"), width=5, percent=80)
    return found.select("doc_id", "n_shingles", "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.length_histogram(table(spark, sf_dir, "documents")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents")).drop("uid")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.verdict(quality_rules.ledger(table(spark, sf_dir, "documents")), policy="v2")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy costs, from one ledger."""
    entries = quality_rules.ledger(table(spark, sf_dir, "documents"))
    each = [quality_rules.ablation(entries, policy).select(F.lit(policy).alias("policy"), "*") for policy in quality_rules.POLICIES]
    return reduce(DataFrame.union, each)


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.winnow(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10, gram=5)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), share=0.5, power=0.5, seed=7, keep=["source", "lang"])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"), confidence=0.8, least_seeds=3, rounds=20)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_secret", "n_added", "n_found")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"quality_ablation": quality_ablation}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_salvage": warc.ORACLE, "op4_ngram_join": join.ORACLE, "op6_license_scan": license_scan.ORACLE, "op7_quality_rules": quality_rules.ORACLE, "quality_ablation": quality_rules.ABLATION_ORACLE, "op8_winnowing": winnowing.ORACLE}
