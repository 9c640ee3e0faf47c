"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, exact_dedup, hard_negatives, jaccard_join, language_id, line_dedup, packing, passage_chains, pii, quality_classifier, quality_rules, resampling, substring_dedup

QUERIES = {
    "op3_passage_chains": passage_chains.op3_passage_chains,
    "op2_quality_classifier": quality_classifier.op2_quality_classifier,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op9_language_id": language_id.op9_language_id,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op4_pii": pii.op4_pii,
    "op5_bpe": bpe.op5_bpe,
    "op6_packing": packing.op6_packing,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op11_resampling": resampling.op11_resampling,
    "op12_line_dedup": line_dedup.op12_line_dedup,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLES = {
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op11_resampling": resampling.ORACLE,
    "op12_line_dedup": line_dedup.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
