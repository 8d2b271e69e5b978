"""All registered queries in name order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardscope.plans import q_contracts, q_feed, q_matching, q_operations, q_routes, q_scores, q_serving, q_stats  # noqa: F401  (they register their queries)
from wardscope.plans.registry import ORACLES, QUERIES


def _utc(build):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        # stamps are compared as UTC on both sides
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return build(spark, folder)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _utc(QUERIES[name]) for name in sorted(QUERIES)}


def oracle_sql() -> dict[str, str]:
    return {name: ORACLES[name] for name in sorted(ORACLES)}
