"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from loomgraph.llm import chat, minhash, mixing, packing, passages, pseudonyms, quality, ruleset, search, sharding, simhash, toxicity, whitening

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_minhash": minhash.op2_minhash,
    "op3_packing": packing.op3_packing,
    "op4_simhash": simhash.op4_simhash,
    "op5_quality": quality.op5_quality,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_pseudonyms": pseudonyms.op7_pseudonyms,
    "op8_chat": chat.op8_chat,
    "op9_passages": passages.op9_passages,
    "op10_sharding": sharding.op10_sharding,
    "op11_whitening": whitening.op11_whitening,
    "op12_search": search.op12_search,
    "op13_rules": ruleset.op13_rules,
}
#: The others hash by functions that SQL has not, train a model or plan a packing; tests hold them
#: against brute force, round trips and held-out labels.
ORACLE = {
    "op5_quality": quality.ORACLE_SQL,
    "op8_chat": chat.ORACLE_SQL,
    "op12_search": search.ORACLE_SQL,
}
