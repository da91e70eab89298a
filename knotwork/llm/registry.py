"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from knotwork.llm import bpe, fingerprints, lattice_lm, mixing, ngram_join, oracle, page_diff, pii, progressive_jpeg, quality, toxicity


def queries() -> dict:
    return {"op1_ngram_join": ngram_join.op1_ngram_join, "op2_lattice_scores": lattice_lm.op2_lattice_scores, "op7_toxicity": toxicity.op7_toxicity, "op9_page_text": page_diff.op9_page_text, "op5_fingerprints": fingerprints.op5_fingerprints, "op10_pseudonyms": pii.op10_pseudonyms, "op4_progressive_jpeg": progressive_jpeg.op4_progressive_jpeg, "op3_source_mix": mixing.op3_source_mix, "op6_byte_bpe": bpe.op6_byte_bpe, "op8_quality": quality.op8_quality, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.ORACLES)
