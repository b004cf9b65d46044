"""Queries of the training-data operators and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, exact_dedup, fingerprints, language_id, license_scan, main_text, merkle, near_dedup, packing, quality, token_counts, url_filter, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_minhash_near_dedup": near_dedup.op2_minhash_near_dedup,
        "op3_url_filter": url_filter.op3_url_filter,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op4_quality": quality.op4_quality,
        "op5_language_id": language_id.op5_language_id,
        "op7_fingerprints": fingerprints.op7_fingerprints,
        "op8_byte_bpe": byte_bpe.op8_byte_bpe,
        "op9_packing": packing.op9_packing,
        "op10_token_counts": token_counts.op10_token_counts,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_main_text": main_text.op12_main_text,
        "op13_merkle_manifest": merkle.op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.ORACLE_SQL,
        "op3_url_filter": url_filter.ORACLE_SQL,
        "op6_exact_dedup": exact_dedup.ORACLE_SQL,
        "op11_vector_codes": vector_codes.ORACLE_SQL,
        "op12_main_text": main_text.op12_main_text,
        "op13_merkle_manifest": merkle.ORACLE_SQL,
    }
