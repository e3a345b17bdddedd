"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, decontaminate, filter_audit, html_extract, importance, language_id, license_scan, line_dedup, mixing, ngram_join, quality_rules, token_counts, toxicity

QUERIES = {
    "op1_ngram_jaccard": ngram_join.op1_ngram_jaccard,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_html_extract": html_extract.op6_html_extract,
    "op7_language_id": language_id.op7_language_id,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_importance_resample": importance.op12_importance_resample,
    "op13_filter_audit": filter_audit.op13_filter_audit,
    # the second operator's links, which the test conversations have none of
    "tool_links": chat_format.tool_links,
}

SQL = {
    "tool_links": chat_format.LINKS_SQL,
    "op5_mix_sources": mixing.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op9_license_scan": license_scan.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
