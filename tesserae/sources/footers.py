"""Answers from the statistics in Parquet footers: extents and counts of tables from which no value is read.

Spark takes minima, maxima and counts from footers if its own Parquet reader is asked to, without filters and grouped by nothing but
folders. Where a footer has no statistics (as for files with NaN or with no value), that fails, and the rows are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.tiles import bounds
from tesserae.sources.raster import label_dtype, source_signature

SOURCES, PUSH_DOWN = "spark.sql.sources.useV1SourceList", "spark.sql.parquet.aggregatePushdown"


@contextmanager
def _statistics(spark: SparkSession) -> Iterator[None]:
    """Read Parquet with aggregates pushed down, for plans that run inside."""
    before = {name: spark.conf.get(name, None) for name in (SOURCES, PUSH_DOWN)}
    spark.conf.set(SOURCES, ",".join(s for s in (before[SOURCES] or "").split(",") if s != "parquet"))
    spark.conf.set(PUSH_DOWN, "true")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def footer_facts(spark: SparkSession, path: str, facts: Sequence[Column], folders: Sequence[str] = ()) -> list[Row] | None:
    """Aggregates of a Parquet table from its footers alone, per value of columns that are `folders`; None if they can't tell.

    `facts` are minima, maxima and counts of plain columns. There is a row per folder, as many as the driver lists anyway.
    """
    with _statistics(spark):
        found = spark.read.parquet(path).groupBy(*folders).agg(*facts)
        if "PushedAggregation: []" in found._jdf.queryExecution().executedPlan().toString():
            return None
        try:
            return found.collect()
        except (Py4JJavaError, PySparkException):
            return None


def bounds_of_path(spark: SparkSession, path: str, x: str = "x", y: str = "y") -> DataFrame:
    """`bounds` of a stored table."""
    facts = [f(c).alias(f"{c}:{n}") for c in dict.fromkeys((x, y)) for n, f in (("low", F.min), ("high", F.max))]
    rows = footer_facts(spark, path, facts)
    ends = [rows[0][f"{c}:{n}"] for c in (x, y) for n in ("low", "high")] if rows else []
    if not ends or any(e is None or not math.isfinite(e) for e in ends):
        return bounds(spark.read.parquet(path), x, y)
    x_min, x_max, y_min, y_max = (float(e) + 0.0 for e in ends)  # statistics may say -0.0 where the value is 0.0
    names = ("x_min", "x_max", "y_min", "y_max", "x_origin", "y_origin")
    return spark.createDataFrame([(x_min, x_max, y_min, y_max, x_min, y_min)], ", ".join(f"{n} double" for n in names))


def count_of_path(spark: SparkSession, path: str) -> int:
    """Rows of a stored table."""
    rows = footer_facts(spark, path, [F.count(F.lit(1)).alias("n")])
    return rows[0]["n"] or 0 if rows else spark.read.parquet(path).count()


def signature_of_path(spark: SparkSession, path: str, region: str = "region", label: str = "label") -> DataFrame:
    """`source_signature` of a stored label raster. Regions in folders of their own need no pixel to be read."""
    pixels = spark.read.parquet(path)
    facts = [F.max("y").alias("y"), F.max("x").alias("x")]
    rows = footer_facts(spark, path, facts, [region])
    if rows is None or any(r["y"] is None or r["x"] is None for r in rows):
        return source_signature(pixels, region, label)
    kind = pixels.schema[region].dataType.simpleString()
    found = spark.createDataFrame(
        [(r[region], "scale0", "y,x", int(r["y"]) + 1, int(r["x"]) + 1, label_dtype(pixels, label)) for r in rows],
        f"region {kind}, scale string, dims string, height long, width long, dtype string",
    )
    return found
