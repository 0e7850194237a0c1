"""All registered queries and their SQL twins."""

from __future__ import annotations

from workload import election_queries, model_queries, run_queries, score_queries, table_queries

_MODULES = (score_queries, table_queries, run_queries, election_queries, model_queries)


def queries() -> dict:
    return {key: run for module in _MODULES for key, run in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {key: sql for module in _MODULES for key, sql in module.oracle_sql().items()}
