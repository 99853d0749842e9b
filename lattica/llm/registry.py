"""Queries over the synthetic tables, one for each operator, and their SQL."""

from . import alignment, audit, chat, decontaminate, hmm, jaccard, oracles, packing, quality, quality_rules, substring, suffix_index, token_counts, topk

QUERIES = {
    f.__name__: f
    for f in (
        topk.op1_exact_top_k,
        packing.op2_harmonic_packing,
        quality.op3_quality_classifier,
        substring.op4_substring_dedup,
        decontaminate.op5_benchmark_decontamination,
        chat.op6_chat_formatting,
        suffix_index.op7_suffix_array_dedup,
        token_counts.op8_token_counts,
        hmm.op9_lm_scoring,
        jaccard.op10_ngram_jaccard_join,
        alignment.op11_cross_tokenizer_alignment,
        audit.op12_filter_interaction_audit,
        quality_rules.op13_quality_rules,
    )
}
#: Packing and alignment need tokenizers, and classifier, token counts and language model are trained or walk a vocabulary: no SQL for these.
SQL: dict[str, str] = {
    "op1_exact_top_k": oracles.TOP_K,
    "op4_substring_dedup": oracles.SUBSTRING,
    "op5_benchmark_decontamination": oracles.CONTAMINATION,
    "op6_chat_formatting": oracles.CHAT,
    "op7_suffix_array_dedup": oracles.SUFFIX,
    "op10_ngram_jaccard_join": oracles.JACCARD,
    "op12_filter_interaction_audit": oracles.AUDIT,
    "op13_quality_rules": oracles.RULED,
}
