"""Queries of the operators, over their whole tables, and the SQL that checks them where SQL can."""

from __future__ import annotations

from binloom.llm import (
    decontaminate, language, lines, lm, minhash, packing, periods, quality, secrets, substrings, token_store, topk, trie,
)

QUERIES = {
    "op1_lm_scores": lm.query,
    "op2_language": language.query,
    "op3_substrings": substrings.query,
    "op4_decontaminate": decontaminate.query,
    "op5_secrets": secrets.query,
    "op6_top_k": topk.query,
    "op7_near_duplicates": minhash.query,
    "op8_token_store": token_store.query,
    "op9_lines": lines.query,
    "op10_packing": packing.query,
    "op11_quality": quality.query,
    "op12_runs": periods.query,
    "op13_trie": trie.query,
}
ORACLE = {
    "op3_substrings": substrings.ORACLE,
    "op4_decontaminate": decontaminate.ORACLE,
    "op6_top_k": topk.ORACLE,
    "op7_near_duplicates": minhash.ORACLE,
    "op13_trie": trie.ORACLE,
}
