"""Queries of the corpus operators, and their comparison SQL where SQL can express them."""

from __future__ import annotations

from sonoframe.llm import byte_bpe, chat, html_text, jaccard, mixing, packing, phrases, pii, quality, spelling, token_counts, vectors


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.query,
        "op2_quality_classifier": quality.query,
        "op3_chat_formatting": chat.query,
        "op4_html_extraction": html_text.query,
        "op5_embedding_near_dedup": vectors.near_query,
        "op6_byte_bpe": byte_bpe.query,
        "op7_ngram_jaccard": jaccard.query,
        "op8_exact_top_k": vectors.top_query,
        "op9_packing": packing.query,
        "op10_pii": pii.query,
        "op11_phrase_collocations": phrases.query,
        "op12_spelling_variants": spelling.query,
        "op13_source_mixing": mixing.query,
    }


def oracle_sql() -> dict:
    return {
        "op3_chat_formatting": chat.ORACLE_SQL,
        "op5_embedding_near_dedup": vectors.NEAR_SQL,
        "op7_ngram_jaccard": jaccard.ORACLE_SQL,
        "op8_exact_top_k": vectors.TOP_SQL,
        "op11_phrase_collocations": phrases.ORACLE_SQL,
        "op12_spelling_variants": spelling.ORACLE_SQL,
    }
