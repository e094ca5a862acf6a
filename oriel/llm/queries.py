"""Registered queries of the corpus operators and the SQL that expresses them."""

from __future__ import annotations

import corpus_pipeline
from oriel.llm import chat, fingerprint, langid, mixing, ngram_join, packing, pii, substring, topk, toxicity

QUERIES = {
    "op1_substring_dedup": substring.op1_substring_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_chat": chat.op3_chat,
    "op4_pii": pii.op4_pii,
    "op5_language_id": langid.op5_language_id,
    "op6_fingerprints": fingerprint.op6_fingerprints,
    "op6_containment": fingerprint.op6_containment,
    "op7_ngram_jaccard": ngram_join.op7_ngram_jaccard,
    "op8_packing": packing.op8_packing,
    "op9_topk": topk.op9_topk,
    "op10_mixing": mixing.op10_mixing,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_substring_dedup": substring.ORACLE,
    "op7_ngram_jaccard": ngram_join.ORACLE,
    "op9_topk": topk.ORACLE,
}

if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
