"""Registered queries of the training-data operators, and DuckDB SQL for those that SQL expresses."""

from vigia.llm import bpe, conversation_repair, decontamination, fingerprints, license_scan, near_dedup, prefix_trie, sharding, substring_dedup, token_counts, token_files, toxicity, url_filters

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_section_tokens": token_counts.op2,
    "op3_url_filters": url_filters.op3,
    "op4_bpe_codec": bpe.op4,
    "op5_license_scan": license_scan.op5,
    "op6_repeated_phrases": substring_dedup.op6,
    "op7_minhash_near_dedup": near_dedup.op7,
    "op8_fingerprints": fingerprints.op8,
    "op9_extendible_shards": sharding.op9,
    "op10_decontamination": decontamination.op10,
    "op11_conversation_repair": conversation_repair.op11,
    "op12_prefix_trie": prefix_trie.op12,
    "op13_token_files": token_files.op13,
}

ORACLE = {
    "op3_url_filters": url_filters.ORACLE,
    "op5_license_scan": license_scan.ORACLE,
    "op9_extendible_shards": sharding.ORACLE,
}
