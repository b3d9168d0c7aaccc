"""The queries of this subpackage by name, and their SQL where there is any."""

from __future__ import annotations

from . import bpe, byte_tries, decontamination, exact_dedup, fingerprints, html_text, jaccard_join, line_templates, packing, quality, sharding, toxicity, whitening

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_packing": packing.op2_packing,
    "op3_line_dedup": line_templates.op3_line_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_token_counts": bpe.op5_token_counts,
    "op6_sharding": sharding.op6_sharding,
    "op7_html_text": html_text.op7_html_text,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_quality": quality.op9_quality,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_exact_dedup": exact_dedup.op11_exact_dedup,
    "op12_divergence": byte_tries.op12_divergence,
    "op13_whitening": whitening.op13_whitening,
}

ORACLES = {
    "op3_line_dedup": line_templates.ORACLE,
    "op8_jaccard_join": jaccard_join.ORACLE,
    "op10_decontamination": decontamination.ORACLE,
    "op11_exact_dedup": exact_dedup.ORACLE,
    "op12_divergence": byte_tries.ORACLE,
}
