"""Queries of this folder and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_compression_bands, op2_decontaminate, op3_preferences, op4_mixing, op5_jaccard_join, op6_language_ppm, op7_token_counts, op8_id_files, op9_secrets, op10_text_density, op11_url_trees, op12_filter_audit, op13_periodic_runs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_compression_bands": op1_compression_bands.query,
        "op2_decontaminate": op2_decontaminate.query,
        "op3_preferences": op3_preferences.query,
        "op4_mixing": op4_mixing.query,
        "op5_jaccard_join": op5_jaccard_join.query,
        "op6_language_ppm": op6_language_ppm.query,
        "op7_token_counts": op7_token_counts.query,
        "op8_id_files": op8_id_files.query,
        "op9_secrets": op9_secrets.query,
        "op10_text_density": op10_text_density.query,
        "op11_url_trees": op11_url_trees.query,
        "op12_filter_audit": op12_filter_audit.query,
        "op13_periodic_runs": op13_periodic_runs.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": op2_decontaminate.SQL,
        "op3_preferences": op3_preferences.SQL,
        "op4_mixing": op4_mixing.SQL,
        "op5_jaccard_join": op5_jaccard_join.SQL,
        "op9_secrets": op9_secrets.SQL,
        "op12_filter_audit": op12_filter_audit.SQL,
    }
