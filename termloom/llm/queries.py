"""Registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from importlib import import_module

#: query name -> module of this package that defines it
_WHERE = {
    "op1_language_id": "language_id",
    "op2_bpe_codec": "bpe_codec",
    "op3_media_columns": "media",
    "op4_token_counts": "token_counts",
    "op5_mix_sources": "mixing",
    "op6_license_scan": "license_scan",
    "op7_substring_dedup": "substring_dedup",
    "op8_lm_scoring": "lm_scoring",
    "op9_jaccard": "jaccard_join",
    "op10_embedding_dedup": "embedding_dedup",
    "op11_packing": "packing",
    "op12_merkle_manifest": "merkle",
    "op13_token_alignment": "token_alignment",
    "page_sequences": "media",
}

#: modules with a ``SQL`` string for their query
_SQL_IN = ("op5_mix_sources", "op6_license_scan", "op9_jaccard", "op12_merkle_manifest")


def queries() -> dict:
    return {name: getattr(import_module(f"termloom.llm.{module}"), name) for name, module in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: import_module(f"termloom.llm.{_WHERE[name]}").SQL for name in _SQL_IN}
