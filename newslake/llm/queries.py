"""The queries of this folder and the SQL that checks them."""

from __future__ import annotations

from newslake.llm import (
    decontaminate,
    language_id,
    line_frequency,
    line_templates,
    near_dedup,
    page_slots,
    quality,
    secret_scan,
    sentencepiece_prefix,
    shallot,
    spelling_variants,
    toxicity,
    url_filter,
)

QUERIES = {
    "op1_line_frequency": line_frequency.op1_line_frequency,
    "op2_quality": quality.op2_quality,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op4_secrets": secret_scan.op4_secrets,
    "op5_language_id": language_id.op5_language_id,
    "op6_sentencepiece": sentencepiece_prefix.op6_sentencepiece,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_line_templates": line_templates.op9_line_templates,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_centroids": shallot.op11_centroids,
    "op12_page_slots": page_slots.op12_page_slots,
    "op13_spelling_variants": spelling_variants.op13_spelling_variants,
}
ORACLES = {
    "op1_line_frequency": line_frequency.SQL,
    "op3_decontamination": decontaminate.SQL,
    "op7_near_dedup": near_dedup.SQL,
    "op9_line_templates": line_templates.SQL,
    "op10_url_filter": url_filter.SQL,
    "op11_centroids": shallot.SQL,
    "op13_spelling_variants": spelling_variants.SQL,
}
