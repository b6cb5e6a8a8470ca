"""Queries of this subpackage, one per operator, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from auditlake.llm import conversations, exact_topk, html_extract, language_id, line_dedup, mixing, near_copies, packing, rotated_codes, secrets, simhash, toxicity, whitening

QUERIES = {
    "op1_html_extract": html_extract.op1_html_extract,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_exact_topk": exact_topk.op3_exact_topk,
    "op4_rotated_codes": rotated_codes.op4_rotated_codes,
    "op5_packing": packing.op5_packing,
    "op6_language_id": language_id.op6_language_id,
    "op7_near_copies": near_copies.op7_near_copies,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_mixing": mixing.op9_mixing,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_simhash": simhash.op11_simhash,
    "op12_whitening": whitening.op12_whitening,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}

ORACLE_SQL = {
    "op3_exact_topk": exact_topk.exact_topk_sql(),
    "op7_near_copies": near_copies.near_copies_sql(),
    "op9_mixing": mixing.mixing_sql(),
    "op10_line_dedup": line_dedup.line_dedup_sql(),
}
