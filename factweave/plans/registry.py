"""Where query modules put their queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factweave.plans.fixtures import frame, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Source:
    """Fixtures and tables by name, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return frame(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    """Registers f(source) under ``name``, with SQL that names fixtures as {fixture}."""

    def put(f: Callable[[Source], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Source(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return put
