"""Registered queries by name, and their DuckDB twins. Tables that a query stages on its way are deleted once its own result is written."""

from functools import partial

from trackspark.plans import complete_queries, fit_queries, more_queries, quality_queries, series_queries, stream_queries, track_queries
from trackspark.staging import alone


def _freed(query, name: str, spark, sf_dir: str):
    return alone(lambda: query(spark, sf_dir), name)


_ALL: dict = track_queries.QUERIES | series_queries.QUERIES | stream_queries.QUERIES | more_queries.QUERIES | fit_queries.QUERIES | quality_queries.QUERIES | complete_queries.QUERIES
QUERIES: dict = {name: partial(_freed, query, name) for name, query in _ALL.items()}
ORACLE_SQL: dict = track_queries.ORACLE_SQL | series_queries.ORACLE_SQL | stream_queries.ORACLE_SQL | more_queries.ORACLE_SQL | fit_queries.ORACLE_SQL | quality_queries.ORACLE_SQL | complete_queries.ORACLE_SQL
