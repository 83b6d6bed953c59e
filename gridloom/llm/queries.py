"""Queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from gridloom.llm import ann, language_id, lm_score, mixing, ngram_join, pii, quality, repeats, sentencepiece_codec, topk

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_quality": quality.op2_quality,
    "op3_topk": topk.op3_topk,
    "op4_repeats": repeats.op4_repeats,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_language": language_id.op6_language,
    "op7_pii": pii.op7_pii,
    "op8_sentencepiece": sentencepiece_codec.op8_sentencepiece,
    "op9_mixing": mixing.op9_mixing,
    "op10_ann": ann.op10_ann,
}
ORACLE_SQL = {"op3_topk": topk.ORACLE_SQL, "op9_mixing": mixing.ORACLE_SQL}
