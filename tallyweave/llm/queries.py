"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from tallyweave.llm import ann, chat, ctw, divergence, jaccard, packing, pieces, pii, quality, substrings, tokenfile, topk, trie

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_exact_topk": topk.op2_exact_topk,
    "op3_suffix_array_dedup": substrings.op3_suffix_array_dedup,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_context_tree": ctw.op5_context_tree,
    "op6_token_files": tokenfile.op6_token_files,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_jaccard_join": jaccard.op8_jaccard_join,
    "op9_pii": pii.op9_pii,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op11_adaptive_scan": ann.op11_adaptive_scan,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_source_divergence": divergence.op13_source_divergence,
}
SQL = {"op2_exact_topk": topk.SQL, "op4_quality_rules": quality.SQL, "op7_chat_formatting": chat.SQL, "op12_prefix_trie": trie.SQL, "op13_source_divergence": divergence.SQL}
