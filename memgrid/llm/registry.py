"""Queries of this subpackage, each with its SQL where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

#: Query name and module.
MODULES = {
    "op1_quality_rules": "quality",
    "op2_language_id": "language_id",
    "op10_html_text": "html_text",
    "op3_simhash_pivots": "simhash",
    "op4_decontamination": "decontaminate",
    "op5_suffix_array": "suffixes",
    "op6_sainte_lague": "mixture",
    "op7_class_model": "class_model",
    "op8_substring_dedup": "substrings",
    "op9_credential_links": "secret_scan",
    "op11_prefix_trie": "prefix_trie",
    "op12_personal_data": "personal_data",
    "op13_fill_middle": "fill_middle",
}


def queries() -> dict[str, Callable]:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
