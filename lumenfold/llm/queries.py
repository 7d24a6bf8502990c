"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from lumenfold.llm import alignment, licences, mixing, neardup, packing, quality, rulelist, search, sharding, substrings, toxicity, vectorcodes, warc

QUERIES = {
    "op1_rule_ensemble_quality": quality.op1_rule_ensemble_quality,
    "op10_deobfuscated_toxicity": toxicity.op10_deobfuscated_toxicity,
    "op11_orchard_codes": vectorcodes.op11_orchard_codes,
    "op12_aligned_tokens": alignment.op12_aligned_tokens,
    "op13_repeated_windows": substrings.op13_repeated_windows,
    "op2_licences": licences.op2_licences,
    "op3_feistel_shards": sharding.op3_feistel_shards,
    "op4_warc_archive": warc.op4_warc_archive,
    "op5_bag_min_hash": neardup.op5_bag_min_hash,
    "op6_packed_sequences": packing.op6_packed_sequences,
    "op7_decision_list": rulelist.op7_decision_list,
    "op8_exact_top_k": search.op8_exact_top_k,
    "op9_mixed_sources": mixing.op9_mixed_sources,
}

ORACLE_SQL = {
    "op11_orchard_codes": vectorcodes.OP11_SQL,
    "op13_repeated_windows": substrings.OP13_SQL,
    "op2_licences": licences.OP2_SQL,
    "op4_warc_archive": warc.OP4_SQL,
    "op8_exact_top_k": search.OP8_SQL,
}
