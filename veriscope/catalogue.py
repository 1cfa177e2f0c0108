"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veriscope.plans import q_eval, q_match, q_more, q_text  # noqa: F401  (they register themselves)
from veriscope.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["x2_ground_batch"](spark, sf)
