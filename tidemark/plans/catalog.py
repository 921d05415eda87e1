"""Every query of this library by name, and the SQL that checks it."""

from __future__ import annotations

from . import bar_queries, sample_queries, series_queries, walk_queries


def queries() -> dict:
    return bar_queries.QUERIES | series_queries.QUERIES | sample_queries.QUERIES | walk_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return bar_queries.ORACLE | series_queries.ORACLE | sample_queries.ORACLE | walk_queries.ORACLE
