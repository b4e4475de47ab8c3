"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from axisgauge.llm import decontaminate, exact_dedup, hard_negatives, language_id, licenses, mixing, ngram_join, repeats, secrets, sharding, token_counts, token_output, whitening

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_suffix_dedup": repeats.op7_suffix_dedup,
    "op8_sharding": sharding.op8_sharding,
    "op9_language_id": language_id.op9_language_id,
    "op10_token_output": token_output.op10_token_output,
    "op11_whitening": whitening.op11_whitening,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_secret_scan": secrets.op13_secret_scan,
}
ORACLE = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op4_ngram_join": ngram_join.OP4_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
}
