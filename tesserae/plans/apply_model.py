"""Batch classification: features, alignment, schema check, prediction, write and provenance as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.palette import default_color
from tesserae.operators.classify import Classifier, apply_config, predict_classifier, prediction_summary, write_predictions
from tesserae.operators.pixels import intensity_features, morphology_features
from tesserae.operators.regions import merge_feature_matrix, requested_regions
from tesserae.scale import settle
from tesserae.sources.catalog import match_images_to_labels
from tesserae.sources.components import read_component, write_table_components
from tesserae.sources.models import classifier_load


def feature_matrix(pixels: DataFrame, channels: Sequence[str], intensity: Sequence[str], morphology: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """`(region, instance_id, features)` and the names of its columns, intensity first."""
    keys = ["region", "label"]
    parts: list[DataFrame] = []
    names: list[str] = []
    if intensity:
        parts.append(intensity_features(pixels, channels, intensity))
        names += [f"{f}__{c}" for f in intensity for c in channels]
    if morphology:
        hull = any(m in ("convex_area", "convex_hull_resid", "centroid_dif") for m in morphology)
        parts.append(morphology_features(pixels, hull=hull).select(*keys, *morphology))
        names += list(morphology)
    table = parts[0]
    for other in parts[1:]:
        table = table.join(other, keys)

    def number(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(float("nan")))

    return table.select("region", F.col("label").alias("instance_id"), F.array(*map(number, names)).alias("features")), names


def check_schema(classifier: Classifier, names: Sequence[str]) -> None:
    if tuple(names) != classifier.feature_columns:
        raise ValueError("The feature columns do not match the classifier, in name or in order.")


def apply_classifier_to_pixels(
    obs: DataFrame, pixels: DataFrame, classifier: Classifier, regions: Sequence[str], declared: Sequence[str], *,
    channels: Sequence[str] = (), intensity: Sequence[str] = (), morphology: Sequence[str] = (),
    class_column: str = "pred_class", confidence_column: str = "pred_confidence", table_name: str = "table",
    classifier_path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The table with predictions for the requested regions, and the provenance row.

    Features are computed once and cut from their lineage, as both the predictions and the counts read them.
    """
    wanted = requested_regions(regions, declared)
    computed, names = feature_matrix(pixels.where(F.col("region").isin(wanted)), channels, intensity, morphology)
    check_schema(classifier, names)
    merged = merge_feature_matrix(obs.select("region", "instance_id"), computed, None, width=len(names), same_schema=False)
    features = settle(merged.where(F.col("region").isin(wanted))).df
    written = write_predictions(
        obs, predict_classifier(features, classifier), wanted, class_column=class_column, confidence_column=confidence_column
    )
    counts = prediction_summary(features, wanted).first()
    provenance = apply_config(
        obs.sparkSession, classifier, table_name=table_name, regions=wanted, predicted=counts["predicted"], skipped=counts["skipped"],
        classifier_path=classifier_path, class_column=class_column, confidence_column=confidence_column,
    )
    return written, provenance


def feature_spec(classifier: Classifier) -> tuple[list[str], list[str], list[str]]:
    """The channels, intensity features and shape features that a classifier's column names ask for."""
    pairs = [name.split("__", 1) for name in classifier.feature_columns if "__" in name]
    channels, intensity = (list(dict.fromkeys(p[i] for p in pairs)) for i in (1, 0))
    return channels, intensity, [name for name in classifier.feature_columns if "__" not in name]


def apply_targets(catalog: DataFrame, regions: Sequence[str], coordinate_system: str | None = None) -> DataFrame:
    """`(coordinate_system, labels, image)`, one row per region: its labels and the one image that fits them.

    Without a coordinate system there must be exactly one in which every region has an image; a region with several images
    there is refused as well. At most one row per requested region and system reaches the driver.
    """
    fitting = match_images_to_labels(catalog.where((F.col("kind") != "labels") | F.col("element").isin(list(regions))))
    if coordinate_system is not None:
        fitting = fitting.where(F.col("coordinate_system") == coordinate_system)
    per_label = fitting.groupBy("coordinate_system", "labels").agg(F.count(F.lit(1)).alias("n"), F.min("image").alias("image"))
    complete = per_label.groupBy("coordinate_system").agg(F.count(F.lit(1)).alias("found"), F.max("n").alias("most"))
    systems = complete.where(F.col("found") == len(set(regions))).orderBy("coordinate_system").limit(3).collect()
    if len(systems) != 1:
        found = [r["coordinate_system"] for r in systems]
        raise ValueError(f"Exactly one coordinate system must hold an image for every region; found {found or 'none'}.")
    if systems[0]["most"] > 1:
        raise ValueError("A region has several images of its size and place; name the image in the catalog.")
    return per_label.where(F.col("coordinate_system") == systems[0]["coordinate_system"]).select("coordinate_system", "labels", "image")


def apply_from_path(
    spark: SparkSession, classifier_path: str, table_path: str, catalog: DataFrame, pixels: DataFrame, regions: Sequence[str] | str, *,
    coordinate_system: str | None = None, class_column: str = "pred_class", confidence_column: str = "pred_confidence", table_name: str = "table",
) -> DataFrame:
    """Load a saved classifier, apply it to the regions of a persisted table, and persist the predictions.

    Targets come from the catalog, channels and features from the classifier's columns. `pixels` has `region, image, label,
    y, x, channel, value`; only those of the targets' images are read. Written are `obs` with the two prediction columns,
    the palette `uns/colors/<class column>` and the provenance `uns/applied/<class column>`; the provenance row is returned.
    """
    classifier = classifier_load(classifier_path)
    obs = read_component(spark, table_path, "obs")
    if obs is None:
        raise ValueError(f"{table_path} holds no obs component.")
    wanted = requested_regions(regions, [r[0] for r in obs.select("region").distinct().collect()])
    targets = apply_targets(catalog, wanted, coordinate_system)
    images = F.broadcast(targets.select(F.col("labels").alias("region"), "image"))  # one row per requested region
    own = pixels.join(images, ["region", "image"], "left_semi").drop("image")
    channels, intensity, morphology = feature_spec(classifier)
    written, provenance = apply_classifier_to_pixels(
        obs, own, classifier, wanted, wanted, channels=channels, intensity=intensity, morphology=morphology, class_column=class_column,
        confidence_column=confidence_column, table_name=table_name, classifier_path=classifier_path,
    )
    row = provenance.withColumn("targets", F.lit([f"{t['labels']}={t['image']}" for t in targets.orderBy("labels").collect()]))
    colors = spark.range(1).select(
        F.to_json(F.create_map(*[c for k in classifier.class_ids for c in (F.lit(str(k)), default_color(F.lit(k)))])).alias("json")
    ).first()[0]
    kept = settle(row).df
    text = kept.select(F.to_json(F.struct(*kept.columns))).first()[0]
    write_table_components(
        spark, table_path, ["obs", f"uns/colors/{class_column}", f"uns/applied/{class_column}"], obs=written,
        uns={f"colors/{class_column}": colors, f"applied/{class_column}": text},
    )
    return kept
