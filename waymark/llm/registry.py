"""Queries of this subpackage, by name, and the SQL that some of them equal."""

from __future__ import annotations

import importlib

#: Module of each query; the module may hold its SQL as ``SQL``.
MODULES = {
    "op1_top_k_search": "topk",
    "op2_ngram_jaccard": "jaccard",
    "op3_substring_dedup": "substrings",
    "op4_bpe_round_trip": "bpe",
    "op5_quality_classifier": "classifier",
    "op6_mix_sources": "mixing",
    "op7_secret_scans": "secrets",
    "op8_quality_rules": "quality_rules",
    "op9_chat_perspectives": "chat",
    "op10_token_files": "token_store",
    "op11_url_filter": "url_filter",
    "op12_prefix_trie": "trie",
    "op13_spelling_variants": "spelling",
}


def queries() -> dict:
    found = {}
    for name, module in MODULES.items():
        found[name] = getattr(importlib.import_module(f"waymark.llm.{module}"), name)
    import corpus_pipeline

    found["pipeline"] = corpus_pipeline.run
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in MODULES.items():
        sql = getattr(importlib.import_module(f"waymark.llm.{module}"), "SQL", None)
        if sql:
            found[name] = sql
    return found
