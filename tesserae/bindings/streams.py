"""Queries on a stream: the events arrive in files, in the order of their times, and each query is stopped and restarted midway."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.bindings.caches import scratch
from tesserae.bindings.registry import query, table
from tesserae.operators.tiles import tile_grid
from tesserae.scale import order_splits, range_of
from tesserae.streaming import counts as C
from tesserae.streaming.tables import current, file_stream, keep_current

FILES = 4


def in_two_runs(spark, folder, aggregate: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """The aggregate of all events: half of the files are there at first, the rest comes before the query is started again."""
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")
    source, path, checkpoint = (scratch(spark) for _ in range(3))
    seconds = events.withColumn("__at", F.unix_timestamp("ts"))
    splits = order_splits(seconds, "__at", rows_per_range=max(1, -(-seconds.count() // FILES)))
    sliced = seconds.withColumn("__slice", range_of(F.col("__at"), splits)).drop("__at")

    def arrive(slices: range) -> None:
        for k in slices:  # one after the other, as files are taken in the order of their times
            sliced.where(F.col("__slice") == k).drop("__slice").coalesce(1).write.mode("append").parquet(source)

    last = len(splits) + 1
    for slices in (range(last // 2), range(last // 2, last)):
        arrive(slices)
        counted = aggregate(file_stream(spark, source, events.schema, files_per_batch=1))
        keep_current(counted, path, checkpoint, partitions=4).awaitTermination()
    return current(spark, path, counted.schema, keys)


@query("stream_value_counts", """
SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, event_type AS value, count(*) AS n_points FROM events GROUP BY ALL""")
def stream_value_counts(spark, folder):
    """Events per day and type, with a watermark of an hour."""
    found = in_two_runs(spark, folder, lambda e: C.windowed_counts(e, "ts", "1 day", "1 hour", "event_type"), ["start", "event_type"])
    day = F.unix_date(F.to_date("start")).cast("long")
    return found.select(day.alias("day"), F.col("event_type").alias("value"), "n_points")


@query("stream_tile_counts", """
SELECT CAST(floor((user_id - x0) / 64.0) AS BIGINT) AS tile_x, CAST(floor((value - y0) / 64.0) AS BIGINT) AS tile_y, count(*) AS n_points
FROM events, (SELECT min(user_id) AS x0, min(value) AS y0 FROM events) GROUP BY ALL""")
def stream_tile_counts(spark, folder):
    grid = tile_grid(table(spark, folder, "events").select(F.col("user_id").alias("x"), F.col("value").alias("y")), leaf=64.0)
    found = in_two_runs(spark, folder, lambda e: C.streaming_tile_counts(e, grid, grid.finest, "user_id", "value"), ["tile_x", "tile_y"])
    return found.select("tile_x", "tile_y", "n_points")


@query("stream_histogram", """
SELECT event_type, CAST(least(floor(value / 4.6875::DOUBLE), 63) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 300 GROUP BY ALL""")
def stream_histogram(spark, folder):
    """64 bins of values up to 300 per event type: a power of two, so that the edges are exact multiples of 300/64."""
    return in_two_runs(spark, folder, lambda e: C.streaming_histogram(e, "value", (0.0, 300.0), 64, "event_type"), ["event_type", "bin"])
