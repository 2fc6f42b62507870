"""The registered queries and their SQL for DuckDB, gathered from the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import crm_queries, governance_queries, graph_queries, question_queries, relational

QUERIES: dict = {}
SQL: dict = {}
for _m in (relational, governance_queries, graph_queries, question_queries, crm_queries):
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top customers by order value, as the role `public` sees them."""
    return governance_queries.flagship(spark, sf_dir)
