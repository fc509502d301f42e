"""Queries of this package and their SQL, by the names that the driver calls them by."""

from __future__ import annotations

from bitloom.llm import decontaminate, language, lmscore, mixing, neardup, pii, quality, secrets, substrings, toxicity

QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_secret_scan": secrets.query,
    "op3_pii": pii.query,
    "op4_lm_score": lmscore.query,
    "op5_language_id": language.query,
    "op6_decontamination": decontaminate.query,
    "op7_near_dedup": neardup.query,
    "op8_toxicity": toxicity.query,
    "op9_substring_dedup": substrings.query,
    "op10_mixing": mixing.query,
}

ORACLE_SQL = {
    "op6_decontamination": decontaminate.ORACLE_SQL,
    "op7_near_dedup": neardup.ORACLE_SQL,
    "op10_mixing": mixing.ORACLE_SQL,
}
