"""The registered queries of this subpackage and their check SQL."""

from __future__ import annotations

from salesflow.llm import alignment, decontamination, lexical_search, mixing, near_dedup, packing, phrase_dedup, quality, suffix_dedup, token_files, toxicity, url_filters, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_url_filters": url_filters.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_quality_rules": quality.query,
    "op5_phrase_dedup": phrase_dedup.query,
    "op6_token_files": token_files.query,
    "op7_toxicity": toxicity.query,
    "op8_mix_sources": mixing.query,
    "op9_decontamination": decontamination.query,
    "op10_near_dedup": near_dedup.query,
    "op11_lexical_search": lexical_search.query,
    "op12_best_two_fit": packing.query,
    "op13_token_alignment": alignment.query,
}
ORACLES = {
    "op1_warc": warc.SQL,
    "op2_url_filters": url_filters.SQL,
    "op3_suffix_dedup": suffix_dedup.SQL,
    "op5_phrase_dedup": phrase_dedup.SQL,
    "op8_mix_sources": mixing.SQL,
    "op10_near_dedup": near_dedup.SQL,
    "op11_lexical_search": lexical_search.SQL,
}
