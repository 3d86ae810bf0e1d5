"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from answerscope.llm import chat_format, decontamination, hamming_search, language_id, license_scan, minhash_join, mixing, periodic_runs, suffix_dedup, toxicity, url_filter, vector_codes, warc

MODULES = (mixing, minhash_join, decontamination, language_id, warc, hamming_search, suffix_dedup, toxicity, url_filter, chat_format, license_scan, periodic_runs, vector_codes)
QUERIES = {name: run for module in MODULES for name, run in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
