"""The opN_ queries and, where SQL can express them over whole tables, their oracle SQL."""

from __future__ import annotations

from spindrift.llm import bpe, dedup, embeddings, fim, langid, mixing, ngram_lm, pii, quality, repeats, secrets, urls


def queries():
    return {
        "op1_language": langid.op1_language,
        "op2_mixing": mixing.op2_mixing,
        "op3_url_filter": urls.op3_url_filter,
        "op4_minhash": dedup.op4_minhash,
        "op5_pii": pii.op5_pii,
        "op6_quality": quality.op6_quality,
        "op7_ngram_lm": ngram_lm.op7_ngram_lm,
        "op8_secrets": secrets.op8_secrets,
        "op9_embeddings": embeddings.op9_embeddings,
        "op10_byte_bpe": bpe.op10_byte_bpe,
        "op11_fim": fim.op11_fim,
        "op12_repeats": repeats.op12_repeats,
    }


def oracle_sql():
    return {"op3_url_filter": urls.op3_sql(), "op4_minhash": dedup.op4_sql(), "op9_embeddings": embeddings.op9_sql(), "op11_fim": fim.op11_sql()}
