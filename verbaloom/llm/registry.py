"""The queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import decontam, langid, lmscore, packing, quality, simhash, substring, tokencount, topk, toxicity


def queries() -> dict:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_lm_scoring": lmscore.op3_lm_scoring,
        "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
        "op5_substring_dedup": substring.op5_substring_dedup,
        "op6_benchmark_decontamination": decontam.op6_benchmark_decontamination,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_exact_top_k": topk.op8_exact_top_k,
        "op9_quality_classifier": quality.op9_quality_classifier,
        "op10_token_counts": tokencount.op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_substring_dedup": substring.OP5_SQL, "op8_exact_top_k": topk.OP8_SQL}
