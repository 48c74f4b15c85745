"""Registry of the queries that the driver runs."""

from __future__ import annotations

from answerlens.plans import audit_queries, constraint_queries, contract_queries, conversation_queries, evaluation_queries, evidence_queries, log_queries, retrieval_queries, routing_queries, selection_queries, source_queries, structured_queries, text_queries  # noqa: F401
from answerlens.plans import registry

FLAGSHIP = "r5_lexical_topk"


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    return dict(registry.ORACLE_SQL)
