import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae import scale


def test_settle_counts_and_keeps_rows(spark):
    sized = scale.settle(spark.range(100).withColumn("s", F.lit("abc")))
    assert sized.rows == 100 and sized.nbytes > 100 and sized.df.count() == 100
    assert sized.broadcastable


def test_checkpoint_folder_is_the_configured_one(spark):
    folder = scale.ensure_checkpoint_dir(spark)
    assert folder == spark.sparkContext.getCheckpointDir()


def test_only_counted_small_sides_are_broadcast(spark, monkeypatch):
    left, right = spark.range(50), spark.range(0, 100, 2)
    hint = "strategy=broadcast"
    assert hint in scale.join_sized(left, right, "id")._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 10)
    joined = scale.join_sized(left, right, "id")
    assert joined.count() == 25 and "__salt" in joined._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 10**6)
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 10)
    assert not scale.measure(right).broadcastable


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_and_missing_keys_are_spread_without_changing_the_join(spark, monkeypatch, how):
    rows = [("hot", i) for i in range(300)] + [(None, i) for i in range(50)] + [(f"k{i}", i) for i in range(20)]
    left = spark.createDataFrame(rows, "k string, v long").repartition(6)
    right = spark.createDataFrame([("hot", "H"), ("k3", "T"), ("k3", "U")], "k string, w string")
    want = sorted(map(str, left.join(right, "k", how).collect()))
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(scale, "HOT_ROWS", 100)
    assert sorted(map(str, scale.join_sized(left, right, "k", how).collect())) == want
    salted, repeated = scale.spread_hot_keys(left, right, ["k"])
    assert salted.where("k = 'hot'").select("__salt").distinct().count() > 1
    assert repeated.where("k = 'hot'").count() == 3 and repeated.where("k = 'k3'").count() == 2


@pytest.mark.parametrize("rows_per_range", [1000, 50, 7])
def test_numbering_with_a_hot_key(spark, rows_per_range):
    rows = [("hot", i) for i in range(400)] + [(f"k{i % 5}", 1000 + i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, pos long").repartition(5)
    splits = scale.order_splits(df, "pos", rows_per_range)
    assert (len(splits) == 0) == (rows_per_range >= 600)
    got = {(r.k, r.pos): r.n for r in scale.cumulate(df, "pos", "n", keys=["k"], splits=splits).collect()}
    seen: dict = {}
    for k, pos in sorted(rows, key=lambda r: r[1]):
        assert got[k, pos] == seen.get(k, 0)
        seen[k] = seen.get(k, 0) + 1


def test_weighted_totals_through_ranges(spark):
    df = spark.createDataFrame([(float(i), i % 4 + 1) for i in range(300)], "v double, n long")
    splits = scale.order_splits(df, "v", 20)
    assert len(splits) > 5
    rows = scale.cumulate(df, "v", "before", weight="n", splits=splits).orderBy("v").collect()
    total = 0
    for row in rows:
        assert row.before == total
        total += row.n


def test_numbering_strings_through_ranges(spark):
    words = [f"w{i:04d}" for i in range(500)]
    df = spark.createDataFrame([(w,) for w in words], "v string").repartition(3)
    got = scale.number_rows(df, "v", "n", rows_per_range=30).orderBy("v").collect()
    assert [r.n for r in got] == list(range(500))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=30, unique=True), st.integers(-60, 60))
def test_range_of_counts_splits(spark, splits, value):
    splits = sorted(splits)
    found = spark.range(1).select(scale.range_of(F.lit(value), splits)).first()[0]
    assert found == sum(s <= value for s in splits)
