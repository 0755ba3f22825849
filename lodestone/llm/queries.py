"""The corpus queries by name, and SQL where SQL can express them."""

from __future__ import annotations

from . import binary, counts, ctw, decontam, html, mixing, neardup, packing, pii, quality, resample, urls, whitening

QUERIES = {
    "op1_token_counts": counts.query,
    "op2_source_mix": mixing.query,
    "op3_decontaminate": decontam.query,
    "op4_main_text": html.query,
    "op5_byte_score": ctw.query,
    "op6_url_rules": urls.query,
    "op7_quality_forest": quality.query,
    "op8_near_duplicates": neardup.query,
    "op9_token_files": binary.query,
    "op10_personal_data": pii.query,
    "op11_target_resample": resample.query,
    "op12_best_fit_packing": packing.query,
    "op13_embedding_whitening": whitening.query,
}
ORACLES = {
    "op2_source_mix": mixing.SQL,
    "op3_decontaminate": decontam.SQL,
    "op8_near_duplicates": neardup.SQL,
    "op11_target_resample": resample.SQL,
}
