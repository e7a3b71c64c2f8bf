"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import concat_packing, fm_quality, license_scan, line_dedup, mixing, packing, pivot_negatives, quality_rules, secret_scan, simhash_dedup, spelling, url_filter, va_topk
from .common import table


def op1_va_file_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_topk.top_k(table(spark, sf_dir, "embeddings"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("places")


def op3_fm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_sequences(table(spark, sf_dir, "documents"))


def op5_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), max_repeats=1.5)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.default_list(spark))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicate_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_dedup.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op10_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op11_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concat_packing.packed(table(spark, sf_dir, "documents"))


def op12_pivot_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), relabel_every=7)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), worn=199)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_va_file_topk": op1_va_file_topk,
        "op2_license_scan": op2_license_scan,
        "op3_fm_quality": op3_fm_quality,
        "op4_best_two_fit_packing": op4_best_two_fit_packing,
        "op5_temperature_mixing": op5_temperature_mixing,
        "op6_secret_scan": op6_secret_scan,
        "op7_url_filter": op7_url_filter,
        "op8_quality_rules": op8_quality_rules,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_fuzzy_line_dedup": op10_fuzzy_line_dedup,
        "op11_concatenate_and_cut": op11_concatenate_and_cut,
        "op12_pivot_hard_negatives": op12_pivot_hard_negatives,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_va_file_topk": va_topk.ORACLE_SQL, "op7_url_filter": url_filter.ORACLE_SQL, "op12_pivot_hard_negatives": pivot_negatives.ORACLE_SQL}
