"""Named queries over the benchmark tables, each with the SQL that gives the same result, where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder) under `name`."""

    def add(function: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"Query {name} is registered twice.")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


_SCHEMAS: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A benchmark table; its schema is read from the footer once per process."""
    path = f"{folder}/{name}.parquet"
    if (folder, name) not in _SCHEMAS:
        _SCHEMAS[folder, name] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[folder, name]).parquet(path)
