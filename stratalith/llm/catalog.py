"""All queries of this subpackage, and the SQL of those that SQL can express."""

from stratalith.llm import decontaminate, exact_dedup, hmm_lm, html_main, license_scan, mixing, ngram_join, secret_scan, token_counts, toxicity

_MODULES = (mixing, secret_scan, ngram_join, exact_dedup, hmm_lm, toxicity, html_main, token_counts, license_scan, decontaminate)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
