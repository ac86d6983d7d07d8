"""Queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from kinpanel.llm import alignment, contamination, exact, jaccard, katz, language, licenses, lines, mixing, pieces, substrings, trie, vectors

QUERIES = {
    "op10_suffix_dedup": (substrings.op10_suffix_dedup, None),
    "op11_token_alignment": (alignment.op11_token_alignment, None),
    "op12_prefix_trie": (trie.op12_prefix_trie, trie.TRIE_SQL),
    "op13_contamination": (contamination.op13_contamination, contamination.CONTAMINATION_SQL),
    "op1_source_mix": (mixing.op1_source_mix, None),
    "op2_sentencepiece": (pieces.op2_sentencepiece, None),
    "op3_exact_dedup": (exact.op3_exact_dedup, exact.EXACT_SQL),
    "op4_lm_scoring": (katz.op4_lm_scoring, None),
    "op5_ngram_jaccard": (jaccard.op5_ngram_jaccard, None),
    "op6_line_dedup": (lines.op6_line_dedup, lines.LINE_SQL),
    "op7_language_id": (language.op7_language_id, None),
    "op8_embedding_near_dedup": (vectors.op8_embedding_near_dedup, None),
    "op9_license_scans": (licenses.op9_license_scans, None),
}
