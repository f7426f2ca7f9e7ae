"""Queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from . import counting_queries, job_queries, library_queries, matching_queries, reading_queries, report_queries, source_queries, text_queries

_ALL = matching_queries.QUERIES | counting_queries.QUERIES | text_queries.QUERIES | report_queries.QUERIES | library_queries.QUERIES | job_queries.QUERIES | source_queries.QUERIES | reading_queries.QUERIES


def queries() -> dict:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
