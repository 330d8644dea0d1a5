"""Registered queries of this subpackage, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from . import chunk_bpe, cotraining, decision_list, hyperminhash, language_id, mpeg_audio, packing, pii_feistel, secret_lexing, token_files

QUERIES = {
    "op1_mpeg_audio": mpeg_audio.op1,
    "op2_decision_list": decision_list.op2,
    "op3_cotraining": cotraining.op3,
    "op4_language_id": language_id.op4,
    "op5_hyperminhash": hyperminhash.op5,
    "op6_packing": packing.op6,
    "op7_token_files": token_files.op7,
    "op8_pii_feistel": pii_feistel.op8,
    "op9_secret_lexing": secret_lexing.op9,
    "op10_chunk_bpe": chunk_bpe.op10,
}
ORACLE_SQL: dict[str, str] = {}
