"""The counting operators on unbounded points: the same aggregates, kept up to date by Structured Streaming.

All are sums over keys, so their state is a row per key. Counts per time window hold only windows that rows may still
reach: with a watermark, a window closes when time has passed its end by more than the delay that is allowed for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.text import normalize_label
from tesserae.operators.histogram import bin_index, check_range
from tesserae.operators.tiles import TileGrid, tile_annotate


def streaming_value_counts(points: DataFrame, label: str) -> DataFrame:
    """Running count per normalised label; write in update or complete mode."""
    return points.groupBy(normalize_label(F.col(label)).alias("value")).agg(F.count(F.lit(1)).alias("n_points"))


def streaming_tile_counts(points: DataFrame, grid: TileGrid, level: int, x: str = "x", y: str = "y") -> DataFrame:
    """Running count per tile of a grid that is fixed beforehand."""
    tiled = tile_annotate(points, grid, level, x, y)
    return tiled.groupBy("tile_id", "tile_x", "tile_y").agg(F.count(F.lit(1)).alias("n_points"))


def streaming_histogram(values: DataFrame, value: str, value_range: tuple[float, float], bins: int, *more: str) -> DataFrame:
    """Running count per bin of a range that is fixed beforehand, and per further columns; values outside are not counted."""
    low, high = (F.lit(v) for v in check_range(value_range))
    binned = values.withColumn("bin", bin_index(F.col(value).cast("double"), low, high, bins))
    return binned.where("bin is not null").groupBy(*more, "bin").agg(F.count(F.lit(1)).alias("n"))


def _watermarked(points: DataFrame, time: str, delay: str) -> tuple[DataFrame, bool]:
    """Points with a watermark on `__time`. Times without a zone are taken as those of UTC, as watermarks need instants."""
    plain = isinstance(points.schema[time].dataType, T.TimestampNTZType)
    instant = F.from_utc_timestamp(F.col(time).cast("timestamp"), F.current_timezone()) if plain else F.col(time)
    return points.withColumn("__time", instant).withWatermark("__time", delay), plain


def windowed_counts(points: DataFrame, time: str, width: str, delay: str, *keys: str) -> DataFrame:
    """Count per time window and keys, `start, end, keys, n_points`. Rows that come later than `delay` behind the latest time
    seen may be dropped, and are once their window is closed."""
    marked, plain = _watermarked(points, time, delay)
    counted = marked.groupBy(F.window("__time", width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n_points"))
    ends = (F.col(f"w.{c}") for c in ("start", "end"))
    ends = [F.to_utc_timestamp(e, F.current_timezone()).cast("timestamp_ntz") if plain else e for e in ends]
    return counted.select(ends[0].alias("start"), ends[1].alias("end"), *keys, "n_points")


def without_repeats(points: DataFrame, identity: str, time: str, delay: str) -> DataFrame:
    """The first row of each identity; a repeat is recognised for as long as `delay` after it, which bounds the state."""
    return _watermarked(points, time, delay)[0].dropDuplicatesWithinWatermark([identity]).drop("__time")
