"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import importlib

#: Query, module, function, name of its SQL in the module.
QUERIES = [
    ("op1_html_main_text", "html_text", "op1", None),
    ("op2_sentencepiece", "lattice", "op2", None),
    ("op3_simhash_near_dedup", "simhash", "op3", None),
    ("op4_quality_rules", "quality_rules", "op4", None),
    ("op5_substring_dedup", "substrings", "op5", None),
    ("op6_mix_sources", "mixing", "op6", "OP6_SQL"),
    ("op7_token_files", "token_files", "op7", None),
    ("op10_lm_scores", "lm", "op10", None),
    ("op8_quality_classifier", "compression_classifier", "op8", None),
    ("op9_media_columns", "media", "op9", None),
]


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{mod}"), f) for name, mod, f, _ in QUERIES}


def oracle_sql() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{mod}"), sql) for name, mod, _, sql in QUERIES if sql}
