"""The queries of this subpackage and the SQL that returns the same rows."""

from __future__ import annotations

from tessella.llm import op1_minhash, op10_suffixes, op2_urls, op3_rules, op4_topk, op5_resampling, op6_packing, op7_bpe, op8_secrets, op9_shards

QUERIES = {
    "op1_minhash_dedup": op1_minhash.op1_minhash_dedup,
    "op2_url_cascade": op2_urls.op2_url_cascade,
    "op3_quality_rules": op3_rules.op3_quality_rules,
    "op4_threshold_topk": op4_topk.op4_threshold_topk,
    "op5_importance_resampling": op5_resampling.op5_importance_resampling,
    "op6_best_fit_packing": op6_packing.op6_best_fit_packing,
    "op7_bpe_round_trip": op7_bpe.op7_bpe_round_trip,
    "op8_secret_scan": op8_secrets.op8_secret_scan,
    "op9_hilbert_shards": op9_shards.op9_hilbert_shards,
    "op10_suffix_dedup": op10_suffixes.op10_suffix_dedup,
}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_dedup": op1_minhash.oracle(),
        "op2_url_cascade": op2_urls.oracle(),
        "op3_quality_rules": op3_rules.oracle(),
        "op4_threshold_topk": op4_topk.oracle(),
    }
