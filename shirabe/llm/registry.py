"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shirabe.session import prepare

# Documents are large rows: batches of so many rows and bytes keep the Python workers small, however long the texts are.
BATCH_ROWS, BATCH_BYTES = "2000", "4m"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under a name, with equivalent SQL where SQL can express it."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(ready(spark), folder)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return register


def ready(spark: SparkSession) -> SparkSession:
    """The session with the settings the operators assume."""
    prepare(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
