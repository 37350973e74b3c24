"""Registry of query keys: one Spark plan and, where SQL can say it, one oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = plan
        if sql is not None:
            ORACLES[key] = sql
        return plan

    return register
