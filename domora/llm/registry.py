"""The registered queries of this subpackage."""

from __future__ import annotations

from domora.llm import alignment, bpe, jaccard, language, mixing, packing, pieces, quality, resampling, suffixes, topk, toxicity, urls

QUERIES = {
    "op1_repetition": quality.op1_repetition,
    "op2_language_mixture": language.op2_language,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_bpe_tree": bpe.op4_bpe_tree,
    "op5_context_mixing": mixing.op5_context_mixing,
    "op6_jaccard_join": jaccard.op6_jaccard_join,
    "op7_pivot_topk": topk.op7_pivot_topk,
    "op8_suffix_dedup": suffixes.op8_suffix_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_url_cascade": urls.op10_url_cascade,
    "op10_listed_names": urls.op10_listed_names,
    "op11_piece_rounds": pieces.op11_piece_rounds,
    "op12_head_tail_resampling": resampling.op12_head_tail_resampling,
    "op13_token_spans": alignment.op13_token_spans,
}
ORACLE_SQL = {"op1_repetition": quality.oracle(), "op6_jaccard_join": jaccard.oracle(), "op7_pivot_topk": topk.ORACLE, "op8_suffix_dedup": suffixes.ORACLE, "op10_url_cascade": urls.oracle(), "op10_listed_names": urls.oracle_by_name(), "op12_head_tail_resampling": resampling.ORACLE}
