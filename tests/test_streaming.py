"""Running aggregates: equal to the batch results, also after failures and restarts; late rows and repeats."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tesserae.operators.histogram import histogram
from tesserae.operators.tiles import TileGrid, tile_annotate, tile_counts
from tesserae.streaming import counts as C
from tesserae.streaming import tables as T

SCHEMA = "id long, at timestamp, kind string, x double, y double"
START = dt.datetime(2024, 1, 1)


def rows(first, n, minutes=1):
    return [(i, START + dt.timedelta(minutes=minutes * i), f" k{i % 3} ", float(i % 9), float(i % 5)) for i in range(first, first + n)]


def arrive(spark, folder, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def places(tmp_path):
    return [str(tmp_path / name) for name in ("source", "table", "checkpoint")]


def run(spark, places, aggregate, **options):
    counted = aggregate(T.file_stream(spark, places[0], SCHEMA, files_per_batch=1))
    query = T.keep_current(counted, places[1], places[2], partitions=3, **options)
    return counted.schema, query


GRID = TileGrid(0.0, 0.0, 9.0, 5.0, 4.0, 1)
CASES = {
    "values": (lambda s: C.streaming_value_counts(s, "kind"), ["value"], lambda d: d.groupBy(F.trim("kind").alias("value")).agg(F.count("*").alias("n_points"))),
    "tiles": (
        lambda s: C.streaming_tile_counts(s, GRID, 0), ["tile_id", "tile_x", "tile_y"],
        lambda d: tile_counts(tile_annotate(d, GRID, 0), 0).select("tile_id", "tile_x", "tile_y", "n_points"),
    ),
    "histogram": (
        lambda s: C.streaming_histogram(s, "x", (1.0, 7.0), 3), ["bin"],
        lambda d: histogram(d, "x", bins=3, value_range=(1.0, 7.0)).select("bin", F.col("count").alias("n")).where("n > 0"),
    ),
}


@pytest.mark.parametrize("case", CASES)
def test_restarts_go_on_where_they_stopped(spark, places, case):
    aggregate, keys, batch = CASES[case]
    store = spark.conf.get(T.STATE_STORE, None)
    arrive(spark, places[0], rows(0, 50))
    arrive(spark, places[0], rows(50, 30))
    schema, query = run(spark, places, aggregate)
    query.awaitTermination()
    assert T.batches(spark, places[1]) == [0, 1]
    arrive(spark, places[0], rows(80, 45))
    schema, query = run(spark, places, aggregate)
    query.awaitTermination()
    assert T.batches(spark, places[1]) == [0, 1, 2]
    got = T.current(spark, places[1], schema, keys)
    want = batch(spark.createDataFrame(rows(0, 125), SCHEMA))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.conf.get(T.STATE_STORE, None) == store


def test_a_batch_that_failed_counts_once(spark, places, monkeypatch):
    """The query dies after it wrote a batch and before it could say so; the batch is written again and counts once."""
    for k in range(3):
        arrive(spark, places[0], rows(40 * k, 40))
    aggregate, keys, batch = CASES["values"]
    counted = aggregate(T.file_stream(spark, places[0], SCHEMA, files_per_batch=1))

    def broken(data, number):
        data.write.mode("overwrite").parquet(f"{places[1]}/batch={number}")
        if number == 1:
            raise RuntimeError("lost")

    query = counted.writeStream.outputMode("update").option("checkpointLocation", places[2]).option("queryName", "dies")
    query = query.foreachBatch(broken).trigger(availableNow=True)
    with T._set(spark, store=T.ROCKSDB, partitions="3"):
        query = query.start()
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    assert T.batches(spark, places[1]) == [0, 1]
    schema, query = run(spark, places, aggregate)
    query.awaitTermination()
    got = T.current(spark, places[1], schema, keys)
    want = batch(spark.createDataFrame(rows(0, 120), SCHEMA))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_count_until_their_window_closes(spark, places):
    def aggregate(stream):
        return C.windowed_counts(stream, "at", "10 minutes", "20 minutes", "kind")

    def counts():
        schema, query = run(spark, places, aggregate)
        query.awaitTermination()
        found = T.current(spark, places[1], schema, ["start", "kind"]).groupBy("start").agg(F.sum("n_points").alias("n")).collect()
        return {(r.start - START).seconds // 60: r.n for r in found}, query

    arrive(spark, places[0], rows(0, 30))
    assert counts()[0] == {0: 10, 10: 10, 20: 10}
    arrive(spark, places[0], rows(5, 1))  # the latest time is 29: windows from 9 on are open, and the first ends at 10
    assert counts()[0] == {0: 11, 10: 10, 20: 10}
    arrive(spark, places[0], rows(60, 5))
    assert counts()[0] == {0: 11, 10: 10, 20: 10, 60: 5}
    arrive(spark, places[0], [*rows(5, 1), *rows(44, 2)])  # now 44 is the border: one row is too late, two are not
    found, query = counts()
    assert found == {0: 11, 10: 10, 20: 10, 40: 2, 60: 5}
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 3 * 4  # closed windows have left the state


def test_times_without_a_zone_keep_their_hours(spark, places):
    spark.createDataFrame(rows(0, 90), SCHEMA).withColumn("at", F.col("at").cast("timestamp_ntz")).coalesce(1).write.parquet(places[0])
    stream = T.file_stream(spark, places[0], SCHEMA.replace("timestamp", "timestamp_ntz"))
    counted = C.windowed_counts(stream, "at", "1 hour", "1 hour")
    T.keep_current(counted, places[1], places[2], partitions=2).awaitTermination()
    found = T.current(spark, places[1], counted.schema, ["start"])
    assert dict(found.dtypes)["start"] == "timestamp_ntz"
    assert {r.start: r.n_points for r in found.collect()} == {START: 60, START + dt.timedelta(hours=1): 30}


def test_repeats_within_the_delay_are_dropped(spark, places):
    arrive(spark, places[0], [*rows(0, 10), *rows(3, 4)])
    arrive(spark, places[0], rows(8, 5))
    schema, query = run(spark, places, lambda s: C.without_repeats(s, "id", "at", "1 hour").groupBy("kind").agg(F.count("*").alias("n")))
    query.awaitTermination()
    assert T.current(spark, places[1], schema, ["kind"]).agg(F.sum("n")).first()[0] == 13


def test_no_batch_yet(spark, places):
    assert T.batches(spark, places[1]) == [] and T.current(spark, places[1], "kind string, n long", ["kind"]).count() == 0
