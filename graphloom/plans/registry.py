"""All registered queries of the engine and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans import queries_code, queries_graph, queries_more, queries_rel, queries_sql, queries_text  # noqa: F401  (they register their queries)
from graphloom.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["x22_hotspots"](spark, sf_dir)
