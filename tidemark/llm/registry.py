"""Queries of this subpackage and the SQL that checks them, where SQL can."""

from __future__ import annotations

from tidemark.llm import byte_bpe, html_text, merkle, onebit_search, packing, pii, simhash_vptree, sorted_projection, spelling, token_records, toxicity, url_filter, weighted_fingerprint


def queries() -> dict:
    return {
        "op1_onebit_search": onebit_search.op1_onebit_search,
        "op2_packing": packing.op2_packing,
        "op3_simhash_vptree": simhash_vptree.op3_simhash_vptree,
        "op4_weighted_fingerprint": weighted_fingerprint.op4_weighted_fingerprint,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_html_text": html_text.op6_html_text,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_pii": pii.op8_pii,
        "op9_token_records": token_records.op9_token_records,
        "op10_byte_bpe": byte_bpe.op10_byte_bpe,
        "op11_sorted_projection": sorted_projection.op11_sorted_projection,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_spelling_variants": spelling.op13_spelling_variants,
    }


def oracle_sql() -> dict:
    return {
        "op7_url_filter": url_filter.oracle(),
        "op11_sorted_projection": sorted_projection.oracle(),
        "op12_merkle_manifest": merkle.oracle(),
        "op13_spelling_variants": spelling.oracle(),
    }
