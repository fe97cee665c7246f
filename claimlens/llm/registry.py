"""Registered queries of the subpackage and their DuckDB statements."""

from claimlens.llm import (byte_bpe, chat_format, class_lm, conversation_trie, decontamination, fingerprints, language_id, lexical_search, ngram_join,
                           pii, secret_scan, sharding, toxicity)

QUERIES = {
    "op1_ngram_join": ngram_join.query,
    "op2_byte_bpe": byte_bpe.query,
    "op3_decontamination": decontamination.query,
    "op4_toxicity": toxicity.query,
    "op5_sharding": sharding.query,
    "op6_pii": pii.query,
    "op7_fingerprints": fingerprints.query,
    "op8_secret_scan": secret_scan.query,
    "op9_language_id": language_id.query,
    "op10_chat_format": chat_format.query,
    "op11_class_lm": class_lm.query,
    "op12_lexical_search": lexical_search.query,
    "op13_conversation_trie": conversation_trie.query,
}
ORACLE_SQL = {
    "op1_ngram_join": ngram_join.ORACLE,
    "op3_decontamination": decontamination.ORACLE,
    "op10_chat_format": chat_format.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
    "op13_conversation_trie": conversation_trie.ORACLE,
}
