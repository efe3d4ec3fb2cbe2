"""The corpus operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import fill_middle, html_text, lexical_search, line_dedup, media, minhash, packing, pieces, quality_rules, secret_scan, sharding, simhash, toxicity

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_html_extraction": html_text.op2_html_extraction,
    "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_document_fingerprints": minhash.op6_document_fingerprints,
    "op7_secret_scans": secret_scan.op7_secret_scans,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_media_columns": media.op10_media_columns,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_quality_rules": quality_rules.op12_quality_rules,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

ORACLES: dict[str, str] = {
    "op9_line_dedup": line_dedup.ORACLE,
    "op11_fill_middle": fill_middle.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}
