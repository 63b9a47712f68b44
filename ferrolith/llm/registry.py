"""The registered queries of the text operators."""

from __future__ import annotations

import corpus_pipeline

from . import exact_dedup, hard_negatives, licenses, mixing, near_dedup, pieces, pii, quality, secrets, substring_dedup, toxicity, url_filter, whitening


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_pii": pii.op3_pii,
        "op4_near_dedup": near_dedup.op4_near_dedup,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_pieces": pieces.op6_pieces,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_secrets": secrets.op8_secrets,
        "op9_licenses": licenses.op9_licenses,
        "op10_mixing": mixing.op10_mixing,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_whitening": whitening.op12_whitening,
        "op13_url_filter": url_filter.op13_url_filter,
    }


def oracle_sql() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.OP1_SQL,
        "op5_substring_dedup": substring_dedup.OP5_SQL,
        "op7_quality_rules": quality.OP7_SQL,
        "op9_licenses": licenses.OP9_SQL,
        "op10_mixing": mixing.OP10_SQL,
        "op11_hard_negatives": hard_negatives.OP11_SQL,
        "op13_url_filter": url_filter.OP13_SQL,
    }
