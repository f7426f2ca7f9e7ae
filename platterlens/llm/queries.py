"""The queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: Query name -> module.
MODULES = {
    "op1_bpe": "bpe",
    "op2_quality_mil": "quality_mil",
    "op3_exact_dedup": "exact_dedup",
    "op4_license_scan": "license_scan",
    "op5_chat_format": "chat_format",
    "op6_suffix_dedup": "suffix_dedup",
    "op7_ngram_jaccard": "ngram_jaccard",
    "op8_language_id": "language_id",
    "op9_quality_rules": "quality_rules",
    "op10_source_mix": "source_mix",
    "op11_merkle_manifest": "merkle_manifest",
    "op12_filter_audit": "filter_audit",
    "op13_pii": "pii",
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{name}")


def queries() -> dict:
    return {k: _module(m).query for k, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, m in MODULES.items() if (sql := getattr(_module(m), "ORACLE", None))}
