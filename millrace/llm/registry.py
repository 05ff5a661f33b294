"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: query -> module
QUERIES = {
    "op1_training_order": "training_order",
    "op2_url_rules": "url_rules",
    "op3_embedding_dedup": "embed_dedup",
    "op4_byte_bpe": "bpe",
    "op5_exact_dedup": "exact_dedup",
    "op6_language_id": "language_id",
    "op7_mixing": "mixing",
    "op8_simhash": "simhash",
    "op9_quality": "quality",
    "op10_toxicity": "toxicity",
    "op11_conversation_trie": "conversation_trie",
    "op12_merkle_manifest": "merkle",
    "op13_secret_scan": "secrets",
}
SQL = {
    "op2_url_rules": ("url_rules", "OP2_SQL"),
    "op3_embedding_dedup": ("embed_dedup", "OP3_SQL"),
    "op5_exact_dedup": ("exact_dedup", "OP5_SQL"),
    "op7_mixing": ("mixing", "OP7_SQL"),
    "op11_conversation_trie": ("conversation_trie", "OP11_SQL"),
    "op12_merkle_manifest": ("merkle", "OP12_SQL"),
    "op13_secret_scan": ("secrets", "OP13_SQL"),
}


def _module(name: str):
    return import_module(f"{__package__}.{name}")


def queries() -> dict:
    return {q: getattr(_module(m), q) for q, m in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {q: getattr(_module(m), name) for q, (m, name) in SQL.items()}
