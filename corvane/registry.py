"""Named queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

LONG_TEXTS = ("documents", "pages")

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name; sql is for DuckDB and may be left out where SQL can't say it."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's rows. Long texts of a file with too few splits are spread over the cores; a large table has enough and stays as it is."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in LONG_TEXTS and rows.rdd.getNumPartitions() < (cores := spark.sparkContext.defaultParallelism):
        rows = rows.repartition(cores)
    return rows
