"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from coppice.llm import chat, embedding_dedup, exact_dedup, hard_negatives, language_id, licenses, line_dedup, mixing, ngram_join, packing, secrets, suffix_dedup, yinyang

QUERIES = {
    "op1_language_id": (language_id.op1_language_id, None),
    "op2_license_scan": (licenses.op2_license_scan, None),
    "op4_embedding_dedup": (embedding_dedup.op4_embedding_dedup, None),
    "op3_mixing": (mixing.op3_mixing, None),
    "op5_line_dedup": (line_dedup.op5_line_dedup, None),
    "op6_exact_dedup": (exact_dedup.op6_exact_dedup, exact_dedup.SQL),
    "op7_chat_format": (chat.op7_chat_format, chat.SQL),
    "op8_packing": (packing.op8_packing, None),
    "op9_secret_scan": (secrets.op9_secret_scan, None),
    "op10_ngram_join": (ngram_join.op10_ngram_join, None),
    "op11_centroid_clustering": (yinyang.op11_centroid_clustering, yinyang.SQL),
    "op12_suffix_dedup": (suffix_dedup.op12_suffix_dedup, None),
    "op13_hard_negatives": (hard_negatives.op13_hard_negatives, hard_negatives.SQL),
}


def queries() -> dict:
    return {name: fn for name, (fn, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
