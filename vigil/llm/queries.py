"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from vigil.llm import bpe, decontaminate, exact_dedup, near_dedup, pii, secrets, substring_dedup, token_counts, toxicity, training_order

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_secrets": secrets.op2_secrets,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_training_order": training_order.op5_training_order,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_bpe": bpe.op7_bpe,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_pii": pii.op10_pii,
}
ORACLE_SQL = {"op4_substring_dedup": substring_dedup.OP4_SQL, "op6_exact_dedup": exact_dedup.OP6_SQL}
