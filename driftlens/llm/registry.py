"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import decontamination, html_extraction, line_dedup, lm, packing, pii, quality, simhash, toxicity, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_lm_scoring": lm.op3_lm_scoring,
    "op4_benchmark_decontamination": decontamination.op4_benchmark_decontamination,
    "op5_simhash": simhash.op5_simhash,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_html_extraction": html_extraction.op7_html_extraction,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_pii": pii.op9_pii,
    "op10_warc": warc.op10_warc,
}

ORACLE_SQL = {
    "op1_line_dedup": line_dedup.ORACLE_SQL,
    "op4_benchmark_decontamination": decontamination.ORACLE_SQL,
    "op6_quality_rules": quality.ORACLE_SQL,
    "op10_warc": warc.ORACLE_SQL,
}
