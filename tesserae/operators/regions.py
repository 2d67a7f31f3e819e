"""Annotation tables keyed by `(region, instance_id)`: filters, guards and joins with shapes and features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.numeric import finite_or_null
from tesserae.scale import join_sized, measure

PREVIEW = 5
KEYS = ["region", "instance_id"]


def requested_regions(requested: Sequence[str] | str, declared: Sequence[str]) -> list[str]:
    """Requested regions in request order, without repeats; all must be declared."""
    wanted = list(dict.fromkeys([requested] if isinstance(requested, str) else [str(r) for r in requested]))
    if not wanted or any(not r for r in wanted):
        raise ValueError("Ask for at least one region, without empty names.")
    absent = sorted(set(wanted) - set(declared))
    if absent:
        raise ValueError(f"The table does not contain region(s): {absent}.")
    return wanted


def region_filter(obs: DataFrame, regions: Sequence[str] | DataFrame) -> DataFrame:
    """Rows of the requested regions. A list becomes a pushed-down filter, a table a semi join."""
    if isinstance(regions, DataFrame):
        return join_sized(obs, measure(regions.select("region").distinct()), "region", "left_semi")
    return obs.where(F.col("region").isin(list(regions)))


def undeclared_regions(requested: DataFrame, labels: DataFrame, declared: DataFrame) -> DataFrame:
    """Requested regions without a labels element, or not declared by the table: `(region, missing_from)`."""
    wanted = requested.select("region").distinct()
    no_labels = wanted.join(labels.select("region").distinct(), "region", "left_anti").withColumn("missing_from", F.lit("labels"))
    no_table = wanted.join(declared.select("region").distinct(), "region", "left_anti").withColumn("missing_from", F.lit("table"))
    return no_labels.unionByName(no_table)


def duplicate_instances(obs: DataFrame, preview: int = PREVIEW) -> DataFrame:
    """Per region, how many instances occur more than once, and the first few of them.

    The preview is a ranked cut, which Spark applies before shuffling; nothing collects all duplicates.
    """
    repeated = obs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    totals = repeated.groupBy("region").agg(F.count(F.lit(1)).alias("n_duplicates"))
    rank = F.row_number().over(Window.partitionBy("region").orderBy("instance_id"))
    first = (
        repeated.withColumn("__rank", rank).where(F.col("__rank") <= preview).groupBy("region")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list("instance_id")), lambda i: i.cast("string")), ", ").alias("preview"))
    )
    return totals.join(first, "region")


def positive_instance(instance: Column) -> Column:
    """Instance as a positive whole number: text is read as a number and truncated; anything else is null."""
    number = finite_or_null(instance.cast("string").try_cast("double")).try_cast("bigint")
    return F.when(number > 0, number)


def positive_instances(obs: DataFrame) -> DataFrame:
    """Rows with a positive instance after coercion."""
    return obs.withColumn("instance_id", positive_instance(F.col("instance_id"))).where("instance_id is not null")


def duplicate_positive_instances(obs: DataFrame) -> DataFrame:
    return positive_instances(obs).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def x_var_values(matrix: DataFrame, obs: DataFrame, var: str) -> DataFrame:
    """One variable's value per row of the (already region-filtered) table; rows without a stored value hold zero.

    `matrix` is the long form `(obs_id, var, value)`; stored partitioned or sorted by `var`, the filter prunes it.
    """
    column = matrix.where(F.col("var") == var).select("obs_id", "value")
    return obs.join(column, "obs_id", "left").withColumn("value", F.coalesce(F.col("value").cast("double"), F.lit(0.0)))


def alignment_problems(shapes: DataFrame, rows: DataFrame) -> DataFrame:
    """Counts of everything that forbids joining a region's table rows to its shapes, and the first rule broken."""
    shape_nulls = shapes.agg(F.count_if(F.col("instance_id").isNull())).scalar()
    per_instance = rows.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n"))
    orphans = per_instance.where("instance_id is not null").join(
        shapes.select("instance_id").distinct(), "instance_id", "left_anti"
    ).agg(F.count(F.lit(1))).scalar()
    counts = per_instance.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("table_rows"),
        F.coalesce(F.sum(F.when(F.col("instance_id").isNull(), F.col("n"))), F.lit(0)).alias("missing_table_instances"),
        F.count_if(F.col("instance_id").isNotNull() & (F.col("n") > 1)).alias("duplicate_table_instances"),
    ).withColumns({"missing_shape_instances": shape_nulls, "instances_without_shape": orphans})
    return counts.withColumn(
        "problem",
        F.when(F.col("missing_shape_instances") > 0, "missing_shape_instances")
        .when(F.col("table_rows") == 0, "no_table_rows")
        .when(F.col("missing_table_instances") > 0, "missing_table_instances")
        .when(F.col("duplicate_table_instances") > 0, "duplicate_table_instances")
        .when(F.col("instances_without_shape") > 0, "instances_without_shape"),
    )


def align_table_to_shapes(shapes: DataFrame, rows: DataFrame) -> DataFrame:
    """Every shape with its instance's table attributes; several shapes may share one instance."""
    flagged = rows.withColumn("has_table_row", F.lit(True))
    return join_sized(shapes, flagged, "instance_id", "left").withColumn(
        "has_table_row", F.coalesce("has_table_row", F.lit(False))
    )


def expand_rendered_rows(shapes: DataFrame, parts: str = "parts") -> DataFrame:
    """One row per part of a multi-part geometry, values repeated. Shapes without parts give none."""
    others = [c for c in shapes.columns if c != parts]
    return shapes.select(*others, F.posexplode(parts).alias("part", "rings"))


def skipped_shapes(shapes: DataFrame, parts: str = "parts") -> DataFrame:
    return shapes.agg(F.count_if(F.col(parts).isNull() | (F.size(parts) == 0)).alias("skipped"))


def merge_feature_matrix(
    obs: DataFrame, new: DataFrame, old: DataFrame | None, *, width: int, same_schema: bool, overwrite: bool = False
) -> DataFrame:
    """Features for the whole table: new ones where computed, old ones elsewhere if their schema is the same, else NaN."""
    if old is not None and not overwrite:
        raise ValueError("The feature matrix exists already; pass overwrite=True to replace it.")
    joined = obs.join(new.select(*KEYS, F.col("features").alias("__new")), KEYS, "left")
    kept = F.lit(None).cast("array<double>")
    if old is not None and same_schema:
        joined = joined.join(old.select(*KEYS, F.col("features").alias("__old")), KEYS, "left")
        computed = new.select("region").distinct().withColumn("__computed", F.lit(True))
        joined = join_sized(joined, computed, "region", "left")
        kept = F.when(F.col("__computed").isNull(), F.col("__old"))
    empty = F.array_repeat(F.lit(float("nan")), width)
    return joined.withColumn("features", F.coalesce("__new", kept, empty)).drop("__new", "__old", "__computed")


def realign_edited_shapes(edited: DataFrame, source: DataFrame, id_column: str = "instance_id") -> DataFrame:
    """Edited rows with the attributes of the source row of the same identity; new rows get nulls."""
    return edited.join(source, id_column, "left")


def union_regions(*tables: DataFrame) -> DataFrame:
    merged = tables[0]
    for other in tables[1:]:
        merged = merged.unionByName(other)
    return merged


def duplicate_into_region(obs: DataFrame, region: str) -> DataFrame:
    """The table followed by a copy of it that annotates a second region."""
    return union_regions(obs, obs.withColumn("region", F.lit(region)))


def random_features(obs: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """Seeded normal features per row."""
    return obs.withColumn("features", F.array(*[F.randn(seed + i) for i in range(width)]))


def class_feature_rows(obs: DataFrame) -> DataFrame:
    """Per object: user class, predicted class, confidence. Absent columns read as missing."""

    def column(name: str, kind: str) -> Column:
        value = F.col(name).cast(kind) if name in obs.columns else F.lit(None).cast(kind)
        return value.alias(name)

    return positive_instances(obs).select(
        *KEYS, column("user_class", "bigint"), column("pred_class", "bigint"), column("pred_confidence", "double")
    )
