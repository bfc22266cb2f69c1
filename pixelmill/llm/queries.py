"""The registered queries of this folder, and their SQL where SQL can say it."""

from __future__ import annotations

from pixelmill.llm.caps import OP12_SQL, op12_embedding_near_dedup
from pixelmill.llm.infill import OP13_SQL, op13_fill_in_middle
from pixelmill.llm.minhash import OP9_SQL, op9_minhash_near_dedup
from pixelmill.llm.nearest import OP8_SQL, op8_exact_top_k
from pixelmill.llm.negatives import OP11_SQL, op11_hard_negatives
from pixelmill.llm.packing import op3_best_fit_packing
from pixelmill.llm.passages import op5_substring_dedup
from pixelmill.llm.quality import op10_quality_rules
from pixelmill.llm.repeats import OP1_SQL, op1_suffix_array_dedup
from pixelmill.llm.suffix_tree import op6_lm_scoring
from pixelmill.llm.toxicity import op2_toxicity
from pixelmill.llm.unigram import op4_token_counts, op7_sentencepiece

QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_token_counts": op4_token_counts,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE = {
    "op1_suffix_array_dedup": OP1_SQL,
    "op8_exact_top_k": OP8_SQL,
    "op9_minhash_near_dedup": OP9_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_embedding_near_dedup": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
