"""Registered queries and their DuckDB equivalents."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.sources import scratch

FLAGSHIP = "catalog_by_content"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with the same in DuckDB where SQL can say it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            scratch.begin()
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


from paperloom.plans import check_plans, citing_plans, elements_plans, ingest_plans, invariant_plans, job_plans, page_plans, repair_plans, tree_plans  # noqa: E402, F401  they register themselves
