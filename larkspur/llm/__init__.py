"""Operators of a training-data pipeline. Nothing else in the package imports this one."""

from larkspur.llm import chat_format, exact_dedup, license_scan, mixing, near_dedup, ngram_join, quality_classifier, quality_rules, repeats, secret_scan, sentencepiece_sampling, spelling, vector_codes

_MODULES = (quality_rules, mixing, exact_dedup, sentencepiece_sampling, near_dedup, repeats, secret_scan, license_scan, quality_classifier, chat_format, spelling, ngram_join, vector_codes)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
