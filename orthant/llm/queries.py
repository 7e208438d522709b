"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat_format, decontamination, license_scan, line_dedup, packing, quality_classifier, quality_rules, simhash_dedup, token_counts, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_quality_rules": quality_rules.query,
    "op3_quality_classifier": quality_classifier.query,
    "op4_packing": packing.query,
    "op5_simhash_dedup": simhash_dedup.query,
    "op6_license_scan": license_scan.query,
    "op7_decontamination": decontamination.query,
    "op8_toxicity": toxicity.query,
    "op9_chat_format": chat_format.query,
    "op10_token_counts": token_counts.query,
}
SQL = {"op9_chat_format": chat_format.SQL}
