"""The registry of named queries: a Spark plan on the tables of a folder, and where SQL can express it the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomstone.tables import Tables

PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in PLANS:
            raise ValueError(f"{name} is registered twice")
        PLANS[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from loomstone.plans import aggregate_queries, flow_queries, graph_queries, importance_queries, insight_queries, rank_queries, scalar_queries, scan_queries, stream_queries, work_queries  # noqa: F401

    return {k: (lambda spark, folder, f=f: f(Tables(spark, folder))) for k, f in PLANS.items()}
