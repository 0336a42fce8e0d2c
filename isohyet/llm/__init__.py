"""Operations of a training-data pipeline: twelve operators, their queries and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module of this subpackage that holds it.
QUERIES = {
    "op1_url_filters": "url_rules",
    "op2_quality_rules": "quality_rules",
    "op3_topk_inner_products": "topk",
    "op4_hypergeometric_sharding": "sharding",
    "op5_minhash_near_dedup": "near_dedup",
    "op6_language_id": "language_id",
    "op7_warc": "warc",
    "op8_best_fit_packing": "packing",
    "op9_mix_sources": "mixing",
    "op10_line_dedup": "line_dedup",
    "op11_hard_negatives": "hard_negatives",
    "op12_lz_fingerprints": "lz_fingerprint",
}


def queries() -> dict:
    return {name: getattr(import_module(f"isohyet.llm.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"isohyet.llm.{module}"), "SQL", None) for name, module in QUERIES.items()}
    return {name: sql for name, sql in found.items() if sql}
