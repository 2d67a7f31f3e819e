"""Facts from footers: equal to those from the rows, and taken from the rows where footers don't tell."""

import math

import pytest
from pyspark.sql import functions as F

from tesserae.operators.tiles import bounds
from tesserae.sources import footers as S
from tesserae.sources.raster import source_signature


@pytest.fixture
def reads(monkeypatch):
    """How often footers gave the answer and how often they didn't."""
    seen, facts = [], S.footer_facts
    monkeypatch.setattr(S, "footer_facts", lambda *a: seen.append(facts(*a)) or seen[-1])
    return lambda: [s is not None for s in seen]


def points(spark, rows, path, parts=3):
    spark.createDataFrame(rows, "x double, y float, g string").repartition(parts).write.parquet(path)
    return path


def test_bounds_and_counts(spark, tmp_path, reads):
    path = points(spark, [(float(i % 17) - 4, float(i), "a") for i in range(200)] + [(None, 3.0, None), (0.0, None, "b")], str(tmp_path / "p"))
    v1, push = spark.conf.get(S.SOURCES), spark.conf.get(S.PUSH_DOWN)
    assert S.bounds_of_path(spark, path).first() == bounds(spark.read.parquet(path)).first()
    assert S.bounds_of_path(spark, path, "y", "y").first() == bounds(spark.read.parquet(path), "y", "y").first()
    assert S.count_of_path(spark, path) == 202 and reads() == [True] * 3
    assert (spark.conf.get(S.SOURCES), spark.conf.get(S.PUSH_DOWN)) == (v1, push)


def test_no_column_is_read(spark, tmp_path):
    path = points(spark, [(1.0, 2.0, "a")], str(tmp_path / "p"))
    with S._statistics(spark):
        plan = spark.read.parquet(path).agg(F.min("x"), F.count(F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MIN(x), COUNT(*)]" in plan and "ReadSchema: struct<min(x):double,count(*):bigint>" in plan


@pytest.mark.parametrize("odd", [math.nan, math.inf, -math.inf, None])
def test_values_that_footers_hide(spark, tmp_path, reads, odd):
    path = points(spark, [(odd, 1.0, "a"), (2.0, -5.0, "a"), (7.5, 0.0, "a")], str(tmp_path / "p"), 1)
    assert tuple(S.bounds_of_path(spark, path).first()) == (2.0, 7.5, -5.0, 1.0, 2.0, -5.0)
    assert reads() == [odd is None or math.isinf(odd)]  # infinite ends are known from the footer, but don't count


def test_zero_has_no_sign(spark, tmp_path):
    path = points(spark, [(0.0, 0.0, "a"), (3.0, 1.0, "a")], str(tmp_path / "p"))
    row = S.bounds_of_path(spark, path).first()
    assert math.copysign(1, row.x_min) == 1 == math.copysign(1, row.y_origin)


def test_empty_and_null_tables(spark, tmp_path):
    path = points(spark, [(None, None, "a")], str(tmp_path / "p"))
    assert tuple(S.bounds_of_path(spark, path).first()) == (None,) * 6
    empty = points(spark, [], str(tmp_path / "e"))
    assert tuple(S.bounds_of_path(spark, empty).first()) == (None,) * 6 and S.count_of_path(spark, empty) == 0


@pytest.mark.parametrize("folders", [True, False])
def test_signatures(spark, tmp_path, reads, folders):
    rows = [(f"r{i % 3}", i % 5, i % 7, (i * i) % 11 + i % 3) for i in range(100)]
    pixels = spark.createDataFrame(rows, "region string, label int, y long, x int")
    path = str(tmp_path / "pixels")
    (pixels.write.partitionBy("region") if folders else pixels.write).parquet(path)
    found = S.signature_of_path(spark, path)
    want = source_signature(pixels)
    assert found.columns == want.columns and sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert reads() == [folders]
