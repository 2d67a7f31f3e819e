"""Annotation tables and shapes elements."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.scale import join_sized


@dataclass(frozen=True)
class ObjectKeys:
    """Which columns of an annotation table name the region and the object in it, and the regions it speaks of."""

    region: str
    instance: str
    regions: tuple[str, ...]


def _is_name(value) -> bool:
    return isinstance(value, str) and value != ""


# what must hold of (region column, object column, regions), each with what to say if it doesn't
KEY_RULES = [
    (lambda region, instance, regions: _is_name(region), "The region column needs a name."),
    (lambda region, instance, regions: _is_name(instance), "The column of object ids needs a name."),
    (lambda region, instance, regions: region != instance, "Regions and object ids need columns of their own."),
    (lambda region, instance, regions: len(regions) > 0, "The table speaks of no region."),
    (lambda region, instance, regions: all(map(_is_name, regions)), "Each region needs a name."),
    (lambda region, instance, regions: len(set(regions)) == len(regions), "A region is named twice."),
]


def object_keys(attributes: Mapping[str, object]) -> ObjectKeys:
    """Keys from a table's attributes `region_key`, `instance_key` and `region`; the last is a name or a list of names."""
    given = attributes.get("region")
    regions = (given,) if isinstance(given, str) else tuple(given) if given is not None else ()
    found = (attributes.get("region_key"), attributes.get("instance_key"), regions)
    broken = next((text for rule, text in KEY_RULES if not rule(*found)), None)
    if broken:
        raise ValueError(broken)
    return ObjectKeys(*found)


def scan_obs_table(df: DataFrame, keys: ObjectKeys) -> DataFrame:
    """The table with its key columns under the names `region` and `instance_id`."""
    absent = {keys.region, keys.instance} - set(df.columns)
    if absent:
        raise ValueError(f"The table has no column {' or '.join(sorted(absent))}.")
    return df.withColumnsRenamed({keys.region: "region", keys.instance: "instance_id"})


def scan_shapes(df: DataFrame, id_column: str = "instance_id", rings: str = "rings") -> DataFrame:
    """Shapes with `problem`: null for a row fit for editing, which has an identity of its own and one valid polygon.

    Else missing_identity, what `validate_polygons` says, or duplicate_identity. Equal rings are checked once.
    """
    from tesserae.operators.spatial import validate_polygons

    keyed = df.withColumn("__shape", F.xxhash64(rings))
    shapes = keyed.select("__shape", rings).dropDuplicates(["__shape"])
    judged = validate_polygons(shapes, "__shape", rings).withColumnRenamed("problem", "__polygon")
    repeated = duplicate_shape_ids(df.where(F.col(id_column).isNotNull()), id_column).select(id_column, F.lit("duplicate_identity").alias("__repeated"))
    found = join_sized(join_sized(keyed, judged, "__shape", "left"), repeated, id_column, "left")
    missing = F.when(F.col(id_column).isNull(), F.lit("missing_identity"))
    problem = F.coalesce(missing, "__polygon", "__repeated")
    return found.withColumn("problem", problem).select(*df.columns, "problem")


def duplicate_shape_ids(df: DataFrame, id_column: str = "instance_id") -> DataFrame:
    return df.groupBy(id_column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
