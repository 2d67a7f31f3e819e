"""From a points table to tiles on disk: validate, count labels, encode, annotate and write the finest level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tesserae.operators.points import ValueDictionary, dictionary_of_profile, encode_labels, profile_points, validation_of_profile
from tesserae.operators.tiles import LEAF_TILE_SIZE, MAX_ROWS_PER_SHARD, TileGrid, tile_annotate, tile_counts, write_tiled_level
from tesserae.sources.components import write_value_dictionary
from tesserae.sources.files import replace_folder
from tesserae.sources.points import PointColumns, check_point_schema


@dataclass(frozen=True)
class TilePlan:
    """A validated points table with its dictionary and grid."""

    points: DataFrame
    columns: PointColumns
    dictionary: ValueDictionary
    grid: TileGrid

    def annotated(self, level: int | None = None) -> DataFrame:
        encoded = encode_labels(self.points, self.columns, self.dictionary)
        return tile_annotate(encoded, self.grid, self.grid.finest if level is None else level)

    def counts(self, level: int | None = None, by_value: bool = False) -> DataFrame:
        level = self.grid.finest if level is None else level
        return tile_counts(self.annotated(level), level, *(["gene_id"] if by_value else []))


def plan_tiles(df: DataFrame, columns: PointColumns, leaf: float = LEAF_TILE_SIZE, n_levels: int | None = None) -> TilePlan:
    """Validation, dictionary and bounds from one scan of the points (grouped by label, then rolled up)."""
    check_point_schema(df, columns)
    profile = profile_points(df, columns)
    row = validation_of_profile(profile.df, columns).first()
    if row["problem"]:
        raise ValueError(f"Points are invalid: {row['problem']}.")
    if n_levels is None:
        extent, n_levels = max(row["max_x"] - row["min_x"], row["max_y"] - row["min_y"]), 1
        while leaf * 2 ** (n_levels - 1) < extent:
            n_levels += 1
    grid = TileGrid(row["min_x"], row["min_y"], row["max_x"], row["max_y"], float(leaf), n_levels)
    return TilePlan(df, columns, dictionary_of_profile(profile), grid)


def build_tiles(
    df: DataFrame, columns: PointColumns, path: str, *, leaf: float = LEAF_TILE_SIZE, n_levels: int | None = None,
    max_rows: int = MAX_ROWS_PER_SHARD,
) -> DataFrame:
    """Write `genes`, the finest level and its `manifest` below `path`; returns the manifest."""
    plan = plan_tiles(df, columns, leaf, n_levels)
    write_value_dictionary(plan.dictionary.values, f"{path}/genes")
    level = plan.grid.finest
    counts = tile_counts(tile_annotate(df, plan.grid, level, columns.x, columns.y), level)  # needs no labels
    manifest = write_tiled_level(plan.annotated(), f"{path}/levels", level, max_rows=max_rows, counts=counts)
    replace_folder(df.sparkSession, f"{path}/manifest", manifest.write.parquet)
    return df.sparkSession.read.parquet(f"{path}/manifest")
