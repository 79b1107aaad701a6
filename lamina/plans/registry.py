"""The list of runnable queries and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamina.plans import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, derive_once: bool = False) -> Callable[[Query], Query]:
    """Register a query, with the SQL that must give the same rows.

    ``derive_once`` is for plans that use the derived voxel table many times: it is then
    written once per run of the query instead of being derived again in every branch.
    """

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            with fixtures.deriving_once():
                return fn(spark, folder)

        QUERIES[name] = run if derive_once else fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
