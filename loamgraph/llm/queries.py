"""The dealt operators over the test tables; SQL where it can express them."""

from __future__ import annotations

from loamgraph.llm import chat, decontaminate, discriminant, html, jaccard, mixing, quality, sharding, spans, toxicity, trie, urls, whitening

QUERIES = {
    "op1_pareto_mix": mixing.op1_pareto_mix,
    "op2_url_trees": urls.op2_url_trees,
    "op3_weak_supervision": quality.op3_weak_supervision,
    "op4_sentence_spans": spans.op4_sentence_spans,
    "op5_prefix_tree_join": jaccard.op5_prefix_tree_join,
    "op6_minhash_containment": decontaminate.op6_minhash_containment,
    "op7_virtual_slots": sharding.op7_virtual_slots,
    "op8_prefix_targets": chat.op8_prefix_targets,
    "op9_dom_tree_model": html.op9_dom_tree_model,
    "op10_subword_softmax": toxicity.op10_subword_softmax,
    "op11_pointer_jumping": trie.op11_pointer_jumping,
    "op12_quadratic_discriminant": discriminant.op12_quadratic_discriminant,
    "op13_subspace_iteration": whitening.op13_subspace_iteration,
}

ORACLE_SQL = {
    "op1_pareto_mix": mixing.SQL,
    "op5_prefix_tree_join": jaccard.SQL,
    "op6_minhash_containment": decontaminate.SQL,
    "op8_prefix_targets": chat.SQL,
    "op11_pointer_jumping": trie.SQL,
}
