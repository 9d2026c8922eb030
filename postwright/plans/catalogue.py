"""Catalogue of the engine's registered queries and their oracles."""

from __future__ import annotations

from postwright.plans import date_queries, email_queries, html_queries, label_queries, model_queries, sync_queries, title_queries

_PARTS = (email_queries.R, date_queries.R, title_queries.R, sync_queries.R, label_queries.R, html_queries.R, model_queries.R)


def queries() -> dict:
    return {name: query for part in _PARTS for name, query in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.oracles.items()}
