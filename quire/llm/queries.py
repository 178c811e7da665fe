"""The dealt operators' queries and their SQL."""

from __future__ import annotations

import corpus_pipeline
from quire.llm import ann, html_text, jaccard_join, language, media_ts, mixing, packing, prefix_trie, quality, resampling, substrings, toxicity, url_filter

QUERIES = {
    "op1_ann": ann.op1,
    "op2_quality": quality.op2,
    "op3_mixing": mixing.op3,
    "op4_media_ts": media_ts.op4,
    "op5_language": language.op5,
    "op6_html_text": html_text.op6,
    "op7_jaccard_join": jaccard_join.op7,
    "op8_toxicity": toxicity.op8,
    "op9_url_filter": url_filter.op9,
    "op10_packing": packing.op10,
    "op11_substrings": substrings.op11,
    "op12_resampling": resampling.op12,
    "op13_prefix_trie": prefix_trie.op13,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op9_url_filter": url_filter.OP9_SQL,
    "op11_substrings": substrings.OP11_SQL,
    "op12_resampling": resampling.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
