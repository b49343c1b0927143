"""Named queries of this subpackage and their SQL oracles."""

from __future__ import annotations

import corpus_pipeline
from tabforge.llm import (
    byte_bpe, cover_join, hard_negatives, language_id, minmax_dedup, mixing, order_minhash, secret_scan, substring_dedup, topk_search, url_filter,
    vector_codes, warc)

QUERIES = {
    "op1_topk_search": topk_search.query,
    "op2_warc": warc.query,
    "op3_language_id": language_id.query,
    "op4_url_filter": url_filter.query,
    "op5_substring_dedup": substring_dedup.query,
    "op6_byte_bpe": byte_bpe.query,
    "op7_order_minhash": order_minhash.query,
    "op8_secret_scan": secret_scan.query,
    "op9_pareto_mix": mixing.query,
    "op10_minmax_dedup": minmax_dedup.query,
    "op11_cover_join": cover_join.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_vector_codes": vector_codes.query,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_topk_search": topk_search.SQL,
    "op2_warc": warc.SQL,
    "op4_url_filter": url_filter.SQL,
    "op5_substring_dedup": substring_dedup.SQL,
    "op9_pareto_mix": mixing.SQL,
    "op11_cover_join": cover_join.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_vector_codes": vector_codes.SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
