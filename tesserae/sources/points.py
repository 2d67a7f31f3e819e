"""Points elements: one row per detected molecule, with numeric coordinates and a string label."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class PointColumns:
    """Names of the columns that play a role in a points table."""

    x: str = "x"
    y: str = "y"
    label: str = "gene"
    points_id: str | None = None

    def names(self) -> list[str]:
        return [c for c in (self.x, self.y, self.label, self.points_id) if c is not None]


def check_point_schema(df: DataFrame, columns: PointColumns) -> None:
    """Schema rules that need no job: roles are present, coordinates numeric, the label a string."""
    if any(not isinstance(name, str) or not name for name in columns.names()):
        raise ValueError("Point column names must be non-empty strings.")
    if columns.label in (columns.x, columns.y):
        raise ValueError("The label column must differ from the coordinate columns.")
    absent = [name for name in columns.names() if name not in df.columns]
    if absent:
        raise ValueError(f"Points lack required column(s): {', '.join(absent)}.")
    for name in (columns.x, columns.y):
        if not isinstance(df.schema[name].dataType, T.NumericType):
            raise ValueError(f"Column {name} must be numeric.")
    if not isinstance(df.schema[columns.label].dataType, T.StringType):
        raise ValueError(f"Column {columns.label} must contain strings.")


def scan_points(source: DataFrame | str, columns: PointColumns, spark: SparkSession | None = None) -> DataFrame:
    """Points with only their role columns, read lazily so that parquet prunes the rest."""
    df = source if isinstance(source, DataFrame) else (spark or SparkSession.active()).read.parquet(source)
    check_point_schema(df, columns)
    return df.select(*columns.names())
