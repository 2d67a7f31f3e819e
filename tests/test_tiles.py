import os
import uuid

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tesserae import scale
from tesserae.operators import tiles as T
from tesserae.plans.build_tiles import build_tiles, plan_tiles
from tesserae.sources.points import PointColumns
from tesserae.sources.row_groups import footer_report, write_row_groups

SCHEMA = "x double, y double, gene_id long, transcript_id string"
ROWS = [(0.0, 10.0, 1, "a"), (99.5, 109.5, 2, "b"), (100.0, 110.0, 3, "c"), (200.0, 210.0, 4, "d")]


def test_annotation_is_half_open(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    grid = T.TileGrid(0.0, 10.0, 200.0, 210.0, 100.0, 2)
    rows = T.tile_annotate(df, grid, 1).orderBy("gene_id").collect()
    assert [r.tile_id for r in rows] == ["1/0/0", "1/0/0", "1/1/1", "1/2/2"]
    assert [(r.x_rel, r.y_rel) for r in rows] == [(0.0, 0.0), (99.5, 99.5), (0.0, 0.0), (0.0, 0.0)]
    assert [r.transcript_id for r in rows] == ["a", "b", "c", "d"]
    kinds = dict(T.tile_annotate(df, grid, 1).dtypes)
    assert kinds["x_rel"] == "float" and kinds["tile_x"] == "bigint"


def test_coarse_level_doubles_the_size(spark):
    df = spark.createDataFrame([(49.0, 0.0, 0, "a")], SCHEMA)
    grid = T.TileGrid(0.0, 0.0, 100.0, 100.0, 25.0, 3)
    assert T.tile_annotate(df, grid, 2).first()["tile_x"] == 1
    assert T.tile_annotate(df, grid, 2).first()["x_rel"] == 24.0
    assert T.tile_annotate(df, grid, 0).first()["tile_x"] == 0


@pytest.mark.parametrize("level", [-1, 3, True, 1.0])
def test_unknown_level(level):
    with pytest.raises(ValueError):
        T.TileGrid(0.0, 0.0, 1.0, 1.0, 1.0, 3).tile_size(level)


@pytest.mark.parametrize("x", [-1.0, float("nan"), float("inf"), 1e13])
def test_impossible_index_stops(spark, x):
    df = spark.createDataFrame([(x, 0.0, 0, "a")], SCHEMA)
    with pytest.raises(Exception, match="32-bit"):
        T.tile_annotate(df, T.TileGrid(0.0, 0.0, 1.0, 1.0, 1.0, 1), 0).collect()


@pytest.mark.parametrize(
    "extent, levels", [(2048.0, [2048.0, 1024.0]), (1024.0, [1024.0]), (0.0, [1024.0]), (2049.0, [4096.0, 2048.0, 1024.0])]
)
def test_levels(spark, extent, levels):
    df = spark.createDataFrame([(10.0, 20.0), (10.0 + extent, 20.0)], "x double, y double")
    rows = T.tile_levels(T.bounds(df)).orderBy("level").collect()
    assert [r.tile_size for r in rows] == levels
    assert [r.is_exact for r in rows] == [False] * (len(levels) - 1) + [True]
    assert T.tile_grid(df).n_levels == len(levels)


def test_exact_power_of_two_needs_no_extra_level(spark):
    for k in (1, 3, 10, 29, 40):
        df = spark.createDataFrame([(0.0, 0.0), (1024.0 * 2**k, 0.0)], "x double, y double")
        assert T.tile_levels(T.bounds(df)).count() == k + 1 == T.tile_grid(df).n_levels


def test_explicit_level_count_wins(spark):
    df = spark.createDataFrame([(0.0, 0.0), (10.0, 10.0)], "x double, y double")
    assert [r.tile_size for r in T.tile_levels(T.bounds(df), n_levels=3).orderBy("level").collect()] == [4096.0, 2048.0, 1024.0]
    for bad in (0, True, 1.5):
        with pytest.raises(ValueError):
            T.tile_grid(df, n_levels=bad)


def test_bounds_ignore_nothing_but_reject_no_finite_value(spark):
    df = spark.createDataFrame([(float("nan"), 1.0)], "x double, y double")
    with pytest.raises(ValueError, match="finite"):
        T.tile_grid(df)


def test_round_trip(spark):
    df = spark.range(500).select((F.rand(1) * 5000).alias("x"), (F.rand(2) * 3000).alias("y"), F.col("id").alias("gene_id"))
    df = df.cache()
    grid = T.tile_grid(df)
    back = T.untile(T.tile_annotate(df, grid, grid.finest), grid, grid.finest)
    worst = df.alias("a").join(back.alias("b"), "gene_id").select(
        F.max(F.greatest(F.abs(F.col("a.x") - F.col("b.x")), F.abs(F.col("a.y") - F.col("b.y"))))
    ).first()[0]
    assert worst < 1e-3


@pytest.mark.parametrize("rows_per_task", [10**6, 50])
def test_written_level_caps_shards_and_keeps_every_row(spark, tmp_path, rows_per_task):
    """A hot tile (two thirds of the rows) is spread over tasks when it exceeds the size of a task."""
    df = spark.range(0, 600, 1, 6).select(
        F.when(F.col("id") % 3 == 0, F.col("id") * 10.0).otherwise(5.0).alias("x"), F.lit(1.0).alias("y"), F.col("id").alias("gene_id")
    )
    grid = T.TileGrid(0.0, 0.0, 6000.0, 1.0, 100.0, 1)
    tiled = T.tile_annotate(df, grid, 0)
    path = str(tmp_path / uuid.uuid4().hex)
    manifest = T.write_tiled_level(tiled, path, 0, max_rows=40, rows_per_task=rows_per_task)
    rows = manifest.collect()
    assert max(r.n_points for r in rows) <= 40 and sum(r.n_points for r in rows) == 600
    counts = {(r.tile_x, r.tile_y): r.n_points for r in T.tile_counts(tiled, 0).collect()}
    for tile, n in counts.items():
        shards = sorted(r.tile_shard for r in rows if (r.tile_x, r.tile_y) == tile)
        assert shards == list(range(len(shards)))
        assert sum(r.n_points for r in rows if (r.tile_x, r.tile_y) == tile) == n
    files = {r.level_file for r in rows if r.tile_x == 0}
    assert (len(files) > 1) == (rows_per_task == 50)
    kept = spark.read.parquet(path).select("tile_id", "gene_id", "x_rel")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, tiled.select(*kept.columns).collect()))


def test_build_tiles(spark, tmp_path):
    rows = [(float(i % 50), float(i // 50), f" g{i % 3} ") for i in range(1000)]
    df = spark.createDataFrame(rows, "x double, y double, gene string")
    path = str(tmp_path / "tiles")
    manifest = build_tiles(df, PointColumns(), path, leaf=8.0, max_rows=20)
    assert manifest.agg(F.sum("n_points")).first()[0] == 1000
    genes = spark.read.parquet(f"{path}/genes").orderBy("gene_id").collect()
    assert [(g.gene, g.n_transcripts) for g in genes] == [("g0", 334), ("g1", 333), ("g2", 333)]
    assert spark.read.parquet(f"{path}/levels").count() == 1000
    with pytest.raises(ValueError, match="empty_label"):
        plan_tiles(df.withColumn("gene", F.lit(" ")), PointColumns())


def test_neighbouring_tiles_share_files(spark, tmp_path):
    df = spark.range(0, 8000, 1, 6).select(
        (F.col("id") % 80 * 10.0).alias("x"), (F.floor(F.col("id") / 80) * 8.0).alias("y"), F.col("id").alias("gene_id")
    )
    tiled = T.tile_annotate(df, T.TileGrid(0.0, 0.0, 800.0, 800.0, 100.0, 1), 0)
    path = str(tmp_path / uuid.uuid4().hex)
    manifest = T.write_tiled_level(tiled, path, 0, partitions=8).collect()
    per_file: dict = {}
    for r in manifest:
        per_file.setdefault(r.level_file, set()).add(r.tile_y)
    assert len(per_file) > 2 and max(map(len, per_file.values())) <= 6  # a file holds a few rows of tiles, not all eight
    row = {r.level_file for r in manifest if r.tile_y == 3}
    assert len(row) <= 2


def grid_points(spark, n=4000, slices=5):
    return spark.range(0, n, 1, slices).select(
        (F.col("id") * 7 % 97 * 10.0).alias("x"), (F.col("id") * 13 % 89 * 8.0).alias("y"), F.col("id").alias("gene_id"))


def test_a_row_group_holds_one_tile(spark, tmp_path):
    tiled = T.tile_annotate(grid_points(spark), T.TileGrid(0.0, 0.0, 970.0, 720.0, 100.0, 1), 0)
    path = str(tmp_path / uuid.uuid4().hex)
    manifest = T.write_tiled_level(tiled, path, 0, max_rows=30, partitions=4)
    rows = {(r.level_file, r.row_group): r for r in manifest.collect()}
    seen = 0
    for name in {f for f, _ in rows}:
        file = pq.ParquetFile(f"{path}/{name}")
        order = []
        for group in range(file.metadata.num_row_groups):
            found = file.read_row_group(group, columns=["tile_x", "tile_y", "tile_id"]).to_pylist()
            row = rows[name, group]
            assert len(found) == row.n_points <= 30
            assert {(f["tile_x"], f["tile_y"], f["tile_id"]) for f in found} == {(row.tile_x, row.tile_y, row.tile_id)}
            order.append((row.tile_y, row.tile_x))
            seen += 1
        assert order == sorted(order)
    assert seen == len(rows)
    assert sorted(map(tuple, T.written_manifest(spark, path, 0).collect())) == sorted(map(tuple, manifest.collect()))


def test_only_the_groups_of_a_tile_are_read(spark, tmp_path):
    tiled = T.tile_annotate(grid_points(spark), T.TileGrid(0.0, 0.0, 970.0, 720.0, 100.0, 1), 0)
    path = str(tmp_path / uuid.uuid4().hex)
    manifest = T.write_tiled_level(tiled, path, 0, max_rows=30, partitions=4)
    chosen = manifest.where("tile_x = 3 AND tile_y IN (2, 5)")
    got = T.read_tiles(spark, path, 0, chosen, ["gene_id", "tile_y"])
    want = tiled.where("tile_x = 3 AND tile_y IN (2, 5)").select("gene_id", "tile_y")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_a_failed_write_leaves_the_level_as_it_was(spark, tmp_path):
    tiled = T.tile_annotate(grid_points(spark), T.TileGrid(0.0, 0.0, 970.0, 720.0, 100.0, 1), 0)
    path = str(tmp_path / uuid.uuid4().hex)
    T.write_tiled_level(tiled, path, 0, partitions=3)
    before = sorted(map(tuple, spark.read.parquet(f"{path}/level=0").collect()))
    broken = tiled.withColumn("gene_id", F.when(F.col("gene_id") == 3999, F.raise_error(F.lit("no"))).otherwise(F.col("gene_id")).cast("long"))
    with pytest.raises(Exception, match="no"):
        T.write_tiled_level(broken, path, 0, partitions=3, counts=T.tile_counts(tiled, 0))
    assert sorted(map(tuple, spark.read.parquet(f"{path}/level=0").collect())) == before
    assert os.listdir(path) == ["level=0"]
    T.write_tiled_level(tiled.where("gene_id < 100"), path, 0)  # and a later one replaces it
    assert spark.read.parquet(f"{path}/level=0").count() == 100
    T.write_tiled_level(tiled.limit(0), path, 0)
    assert T.written_manifest(spark, path, 0).count() == 0


def test_an_attempt_that_is_repeated_writes_the_same_file(spark, tmp_path):
    """The first attempt of each task dies after it wrote; the next one puts the same groups in the same place."""
    tiled = T.tile_annotate(grid_points(spark), T.TileGrid(0.0, 0.0, 970.0, 720.0, 100.0, 1), 0).withColumn("part", F.lit(2))
    folder = str(tmp_path / "groups")
    report = write_row_groups(tiled, folder, 0, "part", 3, 50)
    first, second = (sorted(map(tuple, report.collect())) for _ in range(2))
    assert first == second and os.listdir(folder) == ["part-000002.parquet"]
    assert sorted(map(tuple, footer_report(spark, folder).collect())) == first


def test_far_tiles_keep_their_order(spark, tmp_path):
    big = T.UINT32_MAX
    df = spark.createDataFrame([(big, big, 1.0), (0, big, 2.0), (big, 0, 3.0), (0, 0, 4.0)], "tile_x long, tile_y long, v double")
    manifest = T.write_tiled_level(df, str(tmp_path / "far"), 0, partitions=1)
    rows = manifest.orderBy("row_group").collect()
    assert [(r.tile_x, r.tile_y) for r in rows] == [(0, 0), (big, 0), (0, big), (big, big)]


def test_shards_through_order_ranges(spark, monkeypatch):
    monkeypatch.setattr(scale, "ROWS_PER_RANGE", 100)
    points = spark.range(1000).select(F.col("id").alias("points_id"), (F.col("id") % 3).alias("tile_x"), F.lit(0).alias("tile_y"))
    assert len(scale.order_splits(points, "points_id")) > 5
    assert {r.points_id: r.shard for r in T.shard_rows(points, "points_id", 50).collect()} == {i: i // 3 // 50 for i in range(1000)}
