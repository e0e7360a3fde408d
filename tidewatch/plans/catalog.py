"""Registry of the queries and of the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.plans.views import Tables
from tidewatch.session import configure

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query over the given tables, with its SQL twin where SQL can say it."""
    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build
    return register


def load() -> None:
    """Imports the modules that register queries."""
    from tidewatch.plans import (alert_queries, detect_queries, feature_queries,  # noqa: F401
                                 ingest_queries, scalar_queries, score_queries, stream_queries)


def _fit_local(spark: SparkSession) -> SparkSession:
    """On one machine, as many shuffle partitions as cores instead of the cluster default."""
    if (spark.sparkContext.master.startswith("local")
            and spark.conf.get("spark.sql.shuffle.partitions") == "200"):
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return spark


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return QUERIES[name](Tables(configure(_fit_local(spark)), sf_dir))
    return run
