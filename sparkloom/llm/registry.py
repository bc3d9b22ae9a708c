"""Queries and SQL of this package, by name."""

from __future__ import annotations

from sparkloom.llm import (
    decontaminate, mixing, near_duplicates, quality_classifier, quality_rules, sharding, suffix_dedup, token_output, toxicity, urls,
)

#: The modules of the operators, in the order of their numbers.
MODULES = (near_duplicates, decontaminate, suffix_dedup, quality_rules, mixing, toxicity, quality_classifier, sharding, token_output, urls)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in MODULES for k, sql in m.ORACLES.items()}
