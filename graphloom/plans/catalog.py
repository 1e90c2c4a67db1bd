"""All registered queries of the graph engine and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans import build_queries, compare_queries, graph_queries, other_queries, report_queries, request_queries, standard_queries

MODULES = [graph_queries, standard_queries, report_queries, compare_queries, other_queries, build_queries, request_queries]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: f for m in MODULES for n, f in m.QUERIES.items()}
ORACLE: dict[str, str] = {n: s for m in MODULES for n, s in m.ORACLE.items()}
