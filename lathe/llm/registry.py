"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import bpe, exact_dedup, licenses, lm_score, mixing, pii, quality, secrets, sharding, simhash


def queries():
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_bpe": bpe.op3_bpe,
        "op4_secrets": secrets.op4_secrets,
        "op5_licenses": licenses.op5_licenses,
        "op6_lm_score": lm_score.op6_lm_score,
        "op7_sharding": sharding.op7_sharding,
        "op8_mixing": mixing.op8_mixing,
        "op9_simhash": simhash.op9_simhash,
        "op10_pii": pii.op10_pii,
    }


def oracle_sql():
    return {"op1_exact_dedup": exact_dedup.ORACLE}
