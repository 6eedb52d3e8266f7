"""All queries of this subpackage and the SQL that says the same."""

from __future__ import annotations

from . import alignment_queries, collocation_queries, decontaminate_queries, dedup_queries, line_queries, media_queries, pii_queries, sentencepiece_queries, sharding_queries, token_queries, toxicity_queries

MODULES = (alignment_queries, collocation_queries, decontaminate_queries, dedup_queries, line_queries, media_queries, pii_queries, sentencepiece_queries, sharding_queries, token_queries, toxicity_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
