"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, decontaminate, factors, html, licenses, lm, neardup, packing, quality, secrets, suffixdedup, variants, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_benchmark_decontamination": decontaminate.op1_benchmark_decontamination,
        "op2_secret_scans": secrets.op2_secret_scans,
        "op3_quality_rules": quality.op3_quality_rules,
        "op4_html_extraction": html.op4_html_extraction,
        "op5_suffix_array_dedup": suffixdedup.op5_suffix_array_dedup,
        "op6_lm_scoring": lm.op6_lm_scoring,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_minhash_near_dedup": neardup.op8_minhash_near_dedup,
        "op9_license_scans": licenses.op9_license_scans,
        "op10_warc": warc.op10_warc,
        "op11_spelling_variants": variants.op11_spelling_variants,
        "op12_centroid_clustering": centroids.op12_centroid_clustering,
        "op13_quality_classifier": factors.op13_quality_classifier,
    }


def oracle_sql() -> dict[str, str]:
    """Secret scans and packing rest on trained models and a tokenizer; the
    tests hold them against brute force instead."""
    return {
        "op1_benchmark_decontamination": decontaminate.ORACLE_SQL,
        "op3_quality_rules": quality.oracle_sql(),
        "op8_minhash_near_dedup": neardup.ORACLE_SQL,
        "op9_license_scans": licenses.oracle_sql(),
        "op10_warc": warc.ORACLE_SQL,
        "op12_centroid_clustering": centroids.oracle_sql(),
    }
