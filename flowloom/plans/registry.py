"""All queries of the library, by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowloom.plans import flow_queries, ml_queries, prep_queries, score_queries, source_queries, store_queries

_MODULES = (flow_queries, store_queries, prep_queries, ml_queries, score_queries, source_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
