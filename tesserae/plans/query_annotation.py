"""From cached centers and polygons to an annotated table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tesserae.functions.numeric import Affine
from tesserae.operators.annotate import PreparedAnnotation, annotation_effect, check_target_column, snapshot_of, unresolved_ids
from tesserae.operators.spatial import points_in_polygons
from tesserae.scale import settle

KEYS = ["region", "instance_id"]


@dataclass(frozen=True)
class ReviewedQuery:
    """Matched objects, what the proposed value would change, and everything needed to apply it later."""

    prepared: PreparedAnnotation
    effect: dict[str, int]


def query_centers(centers: DataFrame, polygons: DataFrame, affine: Affine | None = None) -> DataFrame:
    """Objects whose center the polygons cover; the polygons are mapped into the frame of the centers."""
    return points_in_polygons(centers, polygons, KEYS, x="cx", y="cy", affine=affine)


def review_annotation(
    obs: DataFrame, centers: DataFrame, polygons: DataFrame, column: str, value: str | int | None, *, mode: str = "existing",
    affine: Affine | None = None, digest: str = "", signature: str = "",
) -> ReviewedQuery:
    """Run the query, resolve its objects to table rows and count the effect. Nothing is changed."""
    check_target_column(obs, column, mode)
    matched = settle(query_centers(centers, polygons, affine).select(*KEYS)).df  # read twice
    snapshot = settle(snapshot_of(obs, matched, column, value))
    if snapshot.rows == 0:
        raise ValueError("No object matches the query.")
    if unresolved_ids(obs, matched).limit(1).count():
        raise ValueError("A queried object is not in the table.")
    rows = snapshot.df.withColumnRenamed("prepared", column) if mode == "existing" else snapshot.df.drop("prepared")
    effect = annotation_effect(rows, column, value).first().asDict()
    return ReviewedQuery(PreparedAnnotation(snapshot.df, column, mode, digest, signature), effect)
