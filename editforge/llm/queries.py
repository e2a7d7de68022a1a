"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from editforge.llm import alignment, bpe, html_text, line_dedup, lm_score, ngram_join, packing, search, toxicity, url_filter, vector_links, vector_search, whitening

QUERIES = {
    "op1_pseudo_likelihood": lm_score.op1_pseudo_likelihood,
    "op2_line_blocks": html_text.op2_line_blocks,
    "op3_multi_index": vector_links.op3_multi_index,
    "op4_t_occurrence": ngram_join.op4_t_occurrence,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_best_two_fit": packing.op6_best_two_fit,
    "op7_bpe": bpe.op7_bpe,
    "op8_block_max": search.op8_block_max,
    "op9_winnowing": line_dedup.op9_winnowing,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_one_bit_codes": vector_search.op11_one_bit_codes,
    "op12_whitening": whitening.op12_whitening,
    "op13_lockstep": alignment.op13_lockstep,
}

ORACLE = {
    "op10_url_filter": url_filter.OP10_SQL,
}
