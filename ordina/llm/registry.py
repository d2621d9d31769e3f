"""Queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, bpe, hnsw, langid, minhash, mixing, oracles, quotes, tokens, toxicity, urlfilter

QUERIES = {
    "op1_minhash_dedup": minhash.op1_minhash_dedup,
    "op2_url_filter": urlfilter.op2_url_filter,
    "op3_mixing": mixing.op3_mixing,
    "op4_ann": ann.op4_ann,
    "op5_quote_links": quotes.op5_quote_links,
    "op6_bpe": bpe.op6_bpe,
    "op7_language_id": langid.op7_language_id,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_token_files": tokens.op9_token_files,
    "op10_embedding_dedup": hnsw.op10_embedding_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": oracles.OP1_MINHASH_DEDUP,
    "op10_embedding_dedup": oracles.OP10_EMBEDDING_DEDUP,
}
