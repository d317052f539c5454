"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = {
    "op2_lm_scoring": "attention",
    "op5_token_counts": "tokencounts",
    "op6_quality_classifier": "neighbours",
    "op8_html_extraction": "html",
    "op7_suffix_dedup": "suffixdedup",
    "op3_decontamination": "decontaminate",
    "op4_minhash_dedup": "dartminhash",
    "op1_quality_rules": "quality_rules",
    "op10_language_id": "langid",
    "op9_bpe": "bpe",
}


def queries() -> dict:
    return {name: import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
