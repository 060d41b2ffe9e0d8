"""Queries of the language-data operators and their oracle SQL."""

from flowquarry.llm import (
    byte_bpe,
    curriculum,
    dimension_scan,
    fp_search,
    histogram_topk,
    html_extract,
    hyperminhash,
    secrets,
    simhash,
    suffix_dedup,
    token_counts,
    toxicity,
    whitening,
)

MODULES = [
    secrets, byte_bpe, suffix_dedup, html_extract, toxicity, simhash, curriculum, dimension_scan, token_counts, histogram_topk,
    hyperminhash, whitening, fp_search,
]

QUERIES = {m.QUERY.__name__: m.QUERY for m in MODULES}
ORACLE = {m.QUERY.__name__: m.ORACLE_SQL for m in MODULES if getattr(m, "ORACLE_SQL", None)}
