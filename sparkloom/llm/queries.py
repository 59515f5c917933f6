"""The corpus operators' queries, each over its whole table with production parameters."""

from __future__ import annotations

from . import align, decontaminate, html_text, jaccard_join, langid, line_dedup, mih, mixing, negatives, ppm, quality, suffix_dedup, token_counts

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_html_text": html_text.op2_html_text,
    "op3_mih_search": mih.op3_mih_search,
    "op4_ppm_score": ppm.op4_ppm_score,
    "op5_viterbi_counts": token_counts.op5_viterbi_counts,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_ngram_jaccard": jaccard_join.op7_ngram_jaccard,
    "op8_spaced_seeds": decontaminate.op8_spaced_seeds,
    "op9_raking": mixing.op9_raking,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_token_align": align.op11_token_align,
    "op12_quality_votes": quality.op12_quality_votes,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {"op13_hard_negatives": negatives.SQL}
