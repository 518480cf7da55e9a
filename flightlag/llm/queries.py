"""Registered queries of the operators here, and SQL where SQL can say the same."""

from __future__ import annotations

from flightlag.llm import (
    centroids,
    decontaminate,
    exact_dedup,
    filter_audit,
    html_extraction,
    language_id,
    mixing,
    secret_scan,
    sharding,
    simhash,
    suffix_dedup,
    token_files,
    url_filter,
)

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_simhash": simhash.op2_simhash,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_token_files": token_files.op4_token_files,
    "op5_language_id": language_id.op5_language_id,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_mixing": mixing.op7_mixing,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_centroids": centroids.op12_centroids,
    "op13_html_extraction": html_extraction.op13_html_extraction,
}

ORACLES = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_centroids": centroids.OP12_SQL,
}
