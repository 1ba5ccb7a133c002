"""Queries and SQL of the training-data operators, by registered name."""

from __future__ import annotations

from cohortwave.llm import decontamination, exact_dedup, main_text, packing, pii, ranked_search, repair, secrets, shingle_join, simhash, substring_dedup, token_counts, toxicity

MODULES = {
    "op1_pii": pii,
    "op2_exact_dedup": exact_dedup,
    "op3_simhash": simhash,
    "op4_secret_scan": secrets,
    "op5_toxicity": toxicity,
    "op6_decontamination": decontamination,
    "op7_token_counts": token_counts,
    "op8_main_text": main_text,
    "op9_packing": packing,
    "op10_substring_dedup": substring_dedup,
    "op11_ranked_search": ranked_search,
    "op12_shingle_join": shingle_join,
    "op13_conversation_repair": repair,
}
QUERIES = {name: module.query for name, module in MODULES.items()}
ORACLES = {name: module.SQL for name, module in MODULES.items() if hasattr(module, "SQL")}
