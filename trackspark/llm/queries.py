"""Queries of the training-data operators, for the registry."""

from __future__ import annotations

from trackspark.llm import best_fit, byte_cnn, chat_format, collocations, containment, gear_chunks, hilbert_shards, html_extract, jaccard_join, line_frequency, spelling_variants, suffix_dedup, toxicity

QUERIES = {
    "op1_line_frequency": line_frequency.op1_line_frequency,
    "op2_best_fit_packing": best_fit.op2_best_fit_packing,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_gear_chunks": gear_chunks.op4_gear_chunks,
    "op5_minhash_containment": containment.op5_minhash_containment,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_byte_cnn": byte_cnn.op8_byte_cnn,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_phrase_collocations": collocations.op11_phrase_collocations,
    "op12_hilbert_shards": hilbert_shards.op12_hilbert_shards,
    "op13_spelling_variants": spelling_variants.op13_spelling_variants,
}

ORACLE_SQL = {
    "op1_line_frequency": line_frequency.ORACLE_SQL,
    "op3_chat_format": chat_format.ORACLE_SQL,
    "op5_minhash_containment": containment.ORACLE_SQL,
    "op9_jaccard_join": jaccard_join.ORACLE_SQL,
    "op11_phrase_collocations": collocations.ORACLE_SQL,
    "op12_hilbert_shards": hilbert_shards.ORACLE_SQL,
    "op13_spelling_variants": spelling_variants.ORACLE_SQL,
}
