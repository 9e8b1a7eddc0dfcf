"""Queries of this subpackage for the driver's contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grainsift.llm import automaton, kneser_ney, licenses, lines, mixing, packing, redirects, simhash_trie, warc, webp


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_derivatives": warc.op1_warc_derivatives,
        "op2_license_scan": licenses.op2_license_scan,
        "op3_url_redirects": redirects.op3_url_redirects,
        "op4_quality_classifier": kneser_ney.op4_quality_classifier,
        "op5_simhash_near_dedup": simhash_trie.op5_simhash_near_dedup,
        "op6_webp_pixels": webp.op6_webp_pixels,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_substring_dedup": automaton.op8_substring_dedup,
        "reference_substrings": automaton.reference_substrings,
        "op9_line_rules": lines.op9_line_rules,
        "op10_mix_sources": mixing.op10_mix_sources,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_derivatives": warc.SQL,
        "op3_url_redirects": redirects.SQL,
        "op9_line_rules": lines.SQL,
        "op10_mix_sources": mixing.SQL,
    }
