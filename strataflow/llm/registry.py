"""The corpus operators' queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from strataflow.llm import bpe_automaton, chunk_store, decontaminate, exact_dedup, filter_audit, license_rules, order_minhash, prefix_trie, quality, substring_dedup, syncmers, toxicity, warc

QUERIES = {
    "op1_order_minhash": order_minhash.op1_order_minhash,
    "op2_quality_rff": quality.op2_quality_rff,
    "op3_warc_archive": warc.op3_warc_archive,
    "op4_toxicity_chain": toxicity.op4_toxicity_chain,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_license_rules": license_rules.op7_license_rules,
    "op8_chunk_store": chunk_store.op8_chunk_store,
    "op9_bpe_automaton": bpe_automaton.op9_bpe_automaton,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_syncmers": syncmers.op11_syncmers,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLES = {
    "op3_warc_archive": warc.OP3_SQL,
    "op5_substring_dedup": substring_dedup.OP5_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op7_license_rules": license_rules.OP7_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
