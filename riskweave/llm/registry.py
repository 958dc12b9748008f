"""The registered query of each operator, and its SQL where SQL can express it."""
from __future__ import annotations

from riskweave.llm import (
    ann, collocations, decontam, imatch, mixing, near_dedup, quality, secrets, sentences, spelling, substrings, token_store, toxicity,
)

QUERIES = {
    "op1_mixing_sources": mixing.op1_mixing_sources,
    "op2_document_fingerprints": imatch.op2_document_fingerprints,
    "op3_secret_scans": secrets.op3_secret_scans,
    "op4_suffix_array_dedup": substrings.op4_suffix_array_dedup,
    "op5_minhash_near_dedup": near_dedup.op5_minhash_near_dedup,
    "op6_benchmark_decontamination": decontam.op6_benchmark_decontamination,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_token_output": token_store.op9_token_output,
    "op10_sentence_spans": sentences.op10_sentence_spans,
    "op11_nearest_neighbours": ann.op11_nearest_neighbours,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_collocations": collocations.op13_collocations,
}

ORACLES = {
    "op1_mixing_sources": mixing.ORACLE,
    "op5_minhash_near_dedup": near_dedup.ORACLE,
    "op6_benchmark_decontamination": decontam.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
