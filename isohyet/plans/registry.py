"""Every query of the library by name, with its SQL where SQL can express it."""

from __future__ import annotations

from isohyet.plans import cohort_queries, file_queries, history_queries, homogenise_queries, ingest_queries, join_queries, layer_queries, panel_queries, review_queries, spatial_queries, trend_queries

_MODULES = (ingest_queries, join_queries, layer_queries, trend_queries, cohort_queries, history_queries, spatial_queries, review_queries, homogenise_queries, file_queries, panel_queries)


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
