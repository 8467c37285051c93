"""Queries of this subpackage and their DuckDB equivalents, where SQL can say it."""

from __future__ import annotations

from sessile.llm import density, exact_dedup, jaccard, maxent, merkle, mixing, ogg, pieces, pseudonyms, quality, recurrent, spans, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_quality": quality.op3_quality,
    "op4_media_columns": ogg.op4_media_columns,
    "op5_html_extraction": density.op5_html_extraction,
    "op6_ngram_join": jaccard.op6_ngram_join,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_pii": pseudonyms.op8_pii,
    "op9_lm_scoring": maxent.op9_lm_scoring,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_language_id": recurrent.op11_language_id,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_token_alignment": spans.op13_token_alignment,
}
ORACLES = {
    "op1_mixing": mixing.ORACLE,
    "op6_ngram_join": jaccard.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
}
