"""Every query of the engine by name, with its oracle in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from specforge.plans import conformity_queries, document_queries, evidence_queries, question_queries, review_queries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for _part in (conformity_queries, document_queries, evidence_queries, question_queries, review_queries):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
