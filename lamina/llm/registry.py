"""Queries of the corpus operators, by name, and the SQL that says what they return."""

from __future__ import annotations

from . import cover_tree, decontaminate, divergence, flac, language_id, license_scan, mixing, near_dedup, oracle, pii, resampling, secret_scan, token_counts, token_output

QUERIES = {
    "op1_secret_scan": secret_scan.query,
    "op2_token_output": token_output.query,
    "op3_near_dedup": near_dedup.query,
    "op4_mixing": mixing.query,
    "op5_license_scan": license_scan.query,
    "op6_language_id": language_id.query,
    "op7_pii": pii.query,
    "op8_decontaminate": decontaminate.query,
    "op9_flac": flac.query,
    "op10_token_counts": token_counts.query,
    "op11_resampling": resampling.query,
    "op12_divergence": divergence.query,
    "op13_cover_tree": cover_tree.query,
}

ORACLE_SQL = oracle.SQL


def queries() -> dict:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | QUERIES


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    more = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return more | ORACLE_SQL
