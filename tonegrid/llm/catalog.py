"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tonegrid.llm import chat_format, decontaminate, exact_dedup, fill_middle, filter_audit, line_dedup, mixing, quality, secret_scan, simhash, substring_dedup, token_files, url_filter

QUERIES = {
    "op1_secret_scans": secret_scan.query,
    "op2_source_mixing": mixing.query,
    "op3_chat_formatting": chat_format.query,
    "op4_benchmark_decontamination": decontaminate.query,
    "op5_simhash_near_dedup": simhash.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_line_dedup": line_dedup.query,
    "op8_url_filters": url_filter.query,
    "op9_quality_classifier": quality.query,
    "op10_substring_dedup": substring_dedup.query,
    "op11_filter_audit": filter_audit.query,
    "op12_token_files": token_files.query,
    "op13_fill_in_middle": fill_middle.query,
}

ORACLES = {
    "op1_secret_scans": secret_scan.ORACLE,
    "op2_source_mixing": mixing.ORACLE,
    "op3_chat_formatting": chat_format.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op13_fill_in_middle": fill_middle.ORACLE,
}
