"""Multi-level tiling of points."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.numeric import finite_or_null
from tesserae.functions.text import tile_name
from tesserae.scale import ROWS_PER_RANGE, Sized, cumulate, join_sized, order_splits, settle
from tesserae.sources.files import replace_folder
from tesserae.sources.row_groups import footer_report, read_row_groups, write_row_groups

UINT32_MAX = 4294967295
LEAF_TILE_SIZE = 1024.0
MAX_ROWS_PER_SHARD = 50_000
ROWS_PER_WRITE_TASK = 4_000_000


def bounds(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Smallest and largest finite coordinates; the origin is the minimum."""
    ends = df.agg(
        F.min(finite_or_null(F.col(x))).alias("x_min"), F.max(finite_or_null(F.col(x))).alias("x_max"),
        F.min(finite_or_null(F.col(y))).alias("y_min"), F.max(finite_or_null(F.col(y))).alias("y_max"),
    )
    return ends.withColumns({"x_origin": F.col("x_min"), "y_origin": F.col("y_min")})


def tile_levels(ends: DataFrame, leaf: float = LEAF_TILE_SIZE, n_levels: int | None = None) -> DataFrame:
    """Level rows for a `bounds` row: sizes double from the exact, finest level upwards.

    The level count is found by comparing powers of two, which is exact where a logarithm may not be.
    """
    extent = F.greatest(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min"))
    doublings = F.size(F.filter(F.sequence(F.lit(0), F.lit(1000)), lambda k: F.lit(leaf) * F.pow(F.lit(2.0), k) < extent))
    count = F.lit(n_levels) if n_levels is not None else doublings + 1
    rows = ends.withColumn("n_levels", count).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("n_levels") - 1)))
    return rows.select(
        F.col("level").cast("long").alias("level"),
        (F.lit(leaf) * F.pow(F.lit(2.0), F.col("n_levels") - 1 - F.col("level"))).alias("tile_size"),
        (F.col("level") == F.col("n_levels") - 1).alias("is_exact"),
    )


@dataclass(frozen=True)
class TileGrid:
    """Origin and levels of one tiling."""

    x_origin: float
    y_origin: float
    x_max: float
    y_max: float
    leaf: float
    n_levels: int

    def tile_size(self, level: int) -> float:
        if isinstance(level, bool) or not isinstance(level, int) or not 0 <= level < self.n_levels:
            raise ValueError(f"Level {level!r} is not part of this tiling.")
        return self.leaf * 2 ** (self.n_levels - 1 - level)

    @property
    def finest(self) -> int:
        return self.n_levels - 1


def tile_grid(
    df: DataFrame, x: str = "x", y: str = "y", leaf: float = LEAF_TILE_SIZE, n_levels: int | None = None
) -> TileGrid:
    """Compute the bounds (one row) and fix the grid on the driver."""
    if isinstance(leaf, bool) or not math.isfinite(leaf) or leaf <= 0:
        raise ValueError("The leaf tile size must be finite and positive.")
    if n_levels is not None and (isinstance(n_levels, bool) or not isinstance(n_levels, int) or n_levels <= 0):
        raise ValueError("The number of levels must be a positive integer.")
    row = bounds(df, x, y).first()
    if any(row[c] is None for c in ("x_min", "x_max", "y_min", "y_max")):
        raise ValueError("Tile bounds must be finite.")
    extent = max(row["x_max"] - row["x_min"], row["y_max"] - row["y_min"])
    if n_levels is None:
        n_levels = 1
        while leaf * 2 ** (n_levels - 1) < extent:
            n_levels += 1
    return TileGrid(row["x_min"], row["y_min"], row["x_max"], row["y_max"], float(leaf), n_levels)


def tile_index(value: Column, origin: float, size: float) -> Column:
    """Half-open cell number; a value on the far edge belongs to the next tile. Stops on an impossible index."""
    index = F.floor((value.cast("double") - F.lit(origin)) / F.lit(size))
    usable = F.coalesce((index >= 0) & (index <= UINT32_MAX), F.lit(False)) & ~F.isnan(value.cast("double"))
    return F.when(usable, index).otherwise(
        F.raise_error(F.lit("A tile index is not a 32-bit unsigned integer.")).cast("long")
    )


def tile_annotate(df: DataFrame, grid: TileGrid, level: int, x: str = "x", y: str = "y") -> DataFrame:
    """Add `tile_id, tile_x, tile_y` and tile-local float coordinates; the absolute coordinates go."""
    size = grid.tile_size(level)
    indexed = df.withColumns(
        {
            "tile_x": tile_index(F.col(x), grid.x_origin, size),
            "tile_y": tile_index(F.col(y), grid.y_origin, size),
        }
    )
    rest = [c for c in df.columns if c not in (x, y)]
    return indexed.select(
        tile_name(level, F.col("tile_x"), F.col("tile_y")).alias("tile_id"), "tile_x", "tile_y",
        (F.col(x).cast("double") - grid.x_origin - F.col("tile_x") * F.lit(size)).cast("float").alias("x_rel"),
        (F.col(y).cast("double") - grid.y_origin - F.col("tile_y") * F.lit(size)).cast("float").alias("y_rel"),
        *rest,
    )


def untile(df: DataFrame, grid: TileGrid, level: int) -> DataFrame:
    """Absolute coordinates back from tile-local ones."""
    size = grid.tile_size(level)
    rest = [c for c in df.columns if c not in ("tile_id", "tile_x", "tile_y", "x_rel", "y_rel")]
    return df.select(
        (F.lit(grid.x_origin) + F.col("tile_x") * F.lit(size) + F.col("x_rel").cast("double")).alias("x"),
        (F.lit(grid.y_origin) + F.col("tile_y") * F.lit(size) + F.col("y_rel").cast("double")).alias("y"),
        *rest,
    )


def tile_counts(df: DataFrame, level: int, *more: str) -> DataFrame:
    """Points per tile, or per tile and further columns (such as the value). Grouped by the two indices; the tile's name
    is made for the few results."""
    counted = df.groupBy("tile_x", "tile_y", *more).agg(F.count(F.lit(1)).alias("n_points"))
    return counted.select(tile_name(level, F.col("tile_x"), F.col("tile_y")).alias("tile_id"), "tile_x", "tile_y", *more, "n_points")


def grid_counts(df: DataFrame, width: float, height: float, *more: str, x: str = "x", y: str = "y") -> DataFrame:
    """Points per cell of a regular grid, optionally per category."""
    return df.groupBy(
        F.floor(F.col(x) / F.lit(width)).alias("cell_x"), F.floor(F.col(y) / F.lit(height)).alias("cell_y"), *more
    ).agg(F.count(F.lit(1)).alias("n_points"))


def tile_manifest(counts: DataFrame, level: int, max_rows: int = MAX_ROWS_PER_SHARD) -> DataFrame:
    """One row per shard, worked out from the tile counts alone: full shards and one remainder."""
    shards = F.sequence(F.lit(0), F.ceil(F.col("n_points") / F.lit(max_rows)) - 1)
    return counts.withColumn("tile_shard", F.explode(shards)).select(
        F.lit(level).cast("short").alias("level"), "tile_id", "tile_x", "tile_y",
        F.least(F.lit(max_rows), F.col("n_points") - F.col("tile_shard") * max_rows).cast("long").alias("n_points"),
        F.col("tile_shard").cast("int").alias("tile_shard"),
    )


def shard_rows(df: DataFrame, order: str, max_rows: int = MAX_ROWS_PER_SHARD) -> DataFrame:
    """Add `shard`: rows of one tile, in a unique numeric `order`, cut into chunks of `max_rows`.

    Numbering goes through order ranges, so a tile that owns a third of the points is not one task.
    """
    numbered = cumulate(df, order, "__before", keys=["tile_x", "tile_y"], splits=order_splits(df, order))
    return numbered.withColumn("shard", F.floor(F.col("__before") / max_rows)).drop("__before")


def tile_shard_number(chunks: DataFrame) -> DataFrame:
    """Running number of a tile's chunks per level, in file and row-group order (chunk rows, not points)."""
    files = settle(chunks.select("level_file").distinct())
    per_range = max(1, files.rows * ROWS_PER_RANGE // max(1, chunks.count()))
    numbered = cumulate(
        chunks, "level_file", "tile_shard", keys=["level", "tile_x", "tile_y"], splits=order_splits(files, "level_file", per_range), ties=["row_group"])
    return numbered.withColumn("tile_shard", F.col("tile_shard").cast("int"))


def write_tiled_level(
    df: DataFrame, path: str, level: int, *, max_rows: int = MAX_ROWS_PER_SHARD,
    rows_per_task: int = ROWS_PER_WRITE_TASK, partitions: int | None = None, counts: DataFrame | None = None,
) -> DataFrame:
    """Write annotated rows in tile order, one tile per row group, and return the manifest as the writers report it.

    The tile counts cut the row-major order of tiles into stretches of about `rows_per_task` points, one per task and file, so that
    neighbouring tiles share files. A tile above `rows_per_task` is spread over several stretches by the input partition its
    rows come from, which stays the same when a task is retried. A row group has `max_rows` rows at most. `counts` may
    give `tile_counts` if they are cheaper to get elsewhere. The level's folder is replaced when all of it is written.
    """
    spark = df.sparkSession
    known = counts if counts is not None else tile_counts(df, level)
    row_major = (F.col("tile_y") - F.lit(1 << 31)) * F.lit(1 << 32) + F.col("tile_x")  # any two 32-bit numbers fit
    tiles = settle(known.select("tile_x", "tile_y", "n_points", row_major.alias("__order")))
    total = tiles.df.agg(F.sum("n_points")).first()[0] or 0
    slots = 2 * spark.sparkContext.defaultParallelism
    stretch = max(1, min(rows_per_task, -(-total // (partitions or slots))))
    ordered = cumulate(tiles.df, "__order", "__before", weight="n_points", splits=order_splits(tiles, "__order"))
    first = F.floor(F.col("__before") / stretch)
    spread = F.ceil(F.col("n_points") / rows_per_task)
    places = settle(ordered.select("tile_x", "tile_y", first.alias("__first"), spread.alias("__spread")))
    hot = tiles.df.select("tile_x", "tile_y", F.col("n_points").alias("__n"))
    placed = join_sized(df.drop("tile_id"), places, ["tile_x", "tile_y"], counts=hot)
    placed = placed.withColumn("__part", F.col("__first") + F.pmod(F.spark_partition_id(), F.col("__spread"))).drop("__first", "__spread")
    report = []

    def write(folder: str) -> None:
        report.append(settle(write_row_groups(placed, folder, level, "__part", max(1, -(-total // stretch)), max_rows)))

    replace_folder(spark, f"{path}/level={level}", write)
    return _manifest(report[0], level)


def written_manifest(spark: SparkSession, path: str, level: int) -> DataFrame:
    """The manifest of a written level, from the footers of its files."""
    return _manifest(settle(footer_report(spark, f"{path}/level={level}")), level)


def _manifest(report: Sized, level: int) -> DataFrame:
    placed = report.df.withColumn("__order", F.col("part") * F.lit(1 << 31) + F.col("row_group"))
    sized = Sized(placed, report.rows, report.nbytes)
    numbered = cumulate(placed, "__order", "tile_shard", keys=["tile_x", "tile_y"], splits=order_splits(sized, "__order"))
    return numbered.select(
        F.lit(level).cast("short").alias("level"), F.concat(F.lit(f"level={level}/"), "level_file").alias("level_file"),
        tile_name(level, F.col("tile_x"), F.col("tile_y")).alias("tile_id"), "tile_x", "tile_y", "n_points", "row_group",
        F.col("tile_shard").cast("int").alias("tile_shard"),
    )


def read_tiles(spark: SparkSession, path: str, level: int, manifest: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of the tiles in `manifest` (any part of one): only their row groups are read."""
    folder = f"{path}/level={level}"
    schema = spark.read.parquet(folder).select(*columns).schema
    groups = manifest.where(F.col("level") == level).select(F.substring_index("level_file", "/", -1).alias("level_file"), "row_group")
    return read_row_groups(groups, folder, columns, schema)
