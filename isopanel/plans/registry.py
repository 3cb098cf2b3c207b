"""Every query of the engine by name, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import array_queries, comparison_queries, control_queries, exact_queries, graph_queries, model_queries, report_queries, sampling_queries, source_queries, statistics_queries, structure_queries

_PARTS = (graph_queries, statistics_queries, model_queries, report_queries, source_queries, comparison_queries, array_queries, exact_queries, sampling_queries, control_queries, structure_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _PARTS for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _PARTS for k, v in m.ORACLE_SQL.items()}
