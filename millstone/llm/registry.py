"""Queries of the corpus operators and the SQL they are checked against."""

from __future__ import annotations

from millstone.llm import byte_bpe, hnsw, language_id, lexical_packing, ngram_jaccard, order_minhash, quality, secret_scan, suffix_dedup, token_orc

QUERIES = {
    "op1_byte_bpe": byte_bpe.op1_byte_bpe,
    "op2_order_minhash": order_minhash.op2_order_minhash,
    "op3_language_id": language_id.op3_language_id,
    "op4_token_orc": token_orc.op4_token_orc,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_ngram_jaccard": ngram_jaccard.op6_ngram_jaccard,
    "op7_lexical_packing": lexical_packing.op7_lexical_packing,
    "op8_quality": quality.op8_quality,
    "op9_hnsw": hnsw.op9_hnsw,
    "op10_secret_scan": secret_scan.op10_secret_scan,
}

#: the others rest on trained models, a vocabulary file or an approximate search, which SQL can't express
ORACLE_SQL = {
    "op2_order_minhash": order_minhash.ORACLE,
    "op5_suffix_dedup": suffix_dedup.ORACLE,
    "op6_ngram_jaccard": ngram_jaccard.ORACLE,
}
