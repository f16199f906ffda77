"""The corpus queries and their SQL, by the names under which they are registered."""

from __future__ import annotations

from . import byte_bpe, embedding_dedup, license_scan, ngram_join, oracles, packing, quality_rules, secret_scan, substring_dedup, suffix_dedup, toxicity


def queries() -> dict:
    return {
        "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
        "op2_byte_bpe": byte_bpe.op2_byte_bpe,
        "op3_ngram_join": ngram_join.op3_ngram_join,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_license_scan": license_scan.op6_license_scan,
        "op7_packing": packing.op7_packing,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_secret_scan": secret_scan.op9_secret_scan,
        "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
