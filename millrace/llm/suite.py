"""The corpus queries, one per operator, and their SQL where DuckDB can say the same."""

from __future__ import annotations

from . import decontaminate, divergence, embeddings, jaccard, langid, lloyd, mixing, pii, secrets, substrings, tokens, toxicity, warc

QUERIES = {
    "op10_secrets": secrets.op10_secrets,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_divergence": divergence.op12_divergence,
    "op13_lloyd": lloyd.op13_lloyd,
    "op1_pii": pii.op1_pii,
    "op2_substrings": substrings.op2_substrings,
    "op3_tokens": tokens.op3_tokens,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_warc": warc.op6_warc,
    "op7_mixing": mixing.op7_mixing,
    "op8_embeddings": embeddings.op8_embeddings,
    "op9_langid": langid.op9_langid,
}

ORACLE = {
    "op12_divergence": divergence.SQL,
    "op13_lloyd": lloyd.SQL,
    "op2_substrings": substrings.SQL,
    "op4_jaccard": jaccard.SQL,
    "op6_warc": warc.SQL,
    "op7_mixing": mixing.SQL,
    "op8_embeddings": embeddings.SQL,
}
