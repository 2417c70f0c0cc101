"""Registered queries of this subpackage, and SQL where SQL can express one."""

from __future__ import annotations

from deskweave.llm import alignment, bpe, ctw, hilbert, jaccard, language, lexical, mixing, near_vectors, pieces, toxicity, url_rules, wrappers

QUERIES = {
    fn.__name__: fn
    for fn in (
        language.op1_language_bitmask,
        bpe.op2_chunked_bpe,
        near_vectors.op3_pca_tiles,
        ctw.op4_context_tree_weighting,
        hilbert.op5_hilbert_windows,
        wrappers.op6_tree_wrappers,
        toxicity.op7_counterfactual_toxicity,
        mixing.op8_hash_threshold_mix,
        url_rules.op9_reversed_host_sweep,
        jaccard.op10_set_relation_jaccard,
        lexical.op11_geometric_blocks,
        pieces.op12_piece_agenda,
        alignment.op13_fragment_alignment,
    )
}

SQL = {
    "op8_hash_threshold_mix": mixing.OP8_SQL,
    "op9_reversed_host_sweep": url_rules.OP9_SQL,
    "op11_geometric_blocks": lexical.OP11_SQL,
}
