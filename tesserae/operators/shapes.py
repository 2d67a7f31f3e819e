"""Shapes: circles, ellipses, ring paths and identities of edited rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.geometry import ELLIPSE_SEGMENTS, circle_box, ellipse_ring, first, last
from tesserae.functions.numeric import is_finite
from tesserae.functions.text import generated_suffix, is_generated
from tesserae.scale import number_rows

# Fixed value: prefix of identifiers that are generated for new shapes.
ID_PREFIX = "__annotation"


def circle_boxes(df: DataFrame, x: str = "x", y: str = "y", radius: str = "radius") -> DataFrame:
    """Bounding box and diameter of each circle; null where the radius is not positive and finite."""
    return df.withColumn("__box", circle_box(F.col(x), F.col(y), F.col(radius).try_cast("double"))).select(*df.columns, "__box.*")


def circles_qualify(df: DataFrame, radius: str = "radius") -> DataFrame:
    """A table is drawn as circles only if it has rows and every radius is positive and finite."""
    value = F.col(radius).try_cast("double")
    ok = is_finite(value) & (value > 0)
    return df.agg((F.coalesce(F.bool_and(ok), F.lit(False))).alias("qualifies"))


def ellipse_polygons(df: DataFrame, corners: str = "corners", segments: int = ELLIPSE_SEGMENTS) -> DataFrame:
    """`ring` with one vertex per segment; null for a degenerate ellipse."""
    return df.withColumn("ring", ellipse_ring(F.col(corners), segments))


def rings_of_path(path: Column) -> tuple[Column, Column]:
    """Rings and problem of a vertex path: the shell, closed on its first vertex, then each closed hole, followed by the
    shell's first vertex again."""
    n, anchor = F.size(path), first(path)
    marks = F.filter(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.get(path, i - 1) == anchor)
    end = first(marks)
    gaps = F.zip_with(
        F.slice(marks, F.lit(1), F.greatest(F.size(marks) - 1, F.lit(0))), F.slice(marks, F.lit(2), F.greatest(F.size(marks) - 1, F.lit(0))),
        lambda a, b: F.slice(path, a + 1, F.greatest(b - a - 1, F.lit(0))),
    )
    simple = (F.size(marks) == 0) | (end == n)
    problem = (
        F.when(path.isNull() | (n < 3), "too_few_vertices")
        .when(F.exists(path, lambda p: ~(is_finite(p["x"]) & is_finite(p["y"]))), "not_finite")
        .when(simple, F.lit(None).cast("string"))
        .when(end < 4, "shell_too_short").when(last(path) != anchor, "missing_separator")
        .when(F.exists(gaps, lambda h: F.size(h) < 4), "hole_too_short")
        .when(F.exists(gaps, lambda h: first(h) != last(h)), "hole_not_closed")
    )
    shell = F.slice(path, F.lit(1), F.when(F.size(marks) == 0, n).otherwise(end))
    rings = F.when(simple, F.array(shell)).otherwise(F.concat(F.array(shell), gaps))
    return F.when(problem.isNull(), rings), problem


def rings_from_paths(df: DataFrame, path: str = "path") -> DataFrame:
    rings, problem = rings_of_path(F.col(path))
    return df.withColumns({"rings": rings, "path_problem": problem})


def dedupe_generated_ids(rows: DataFrame, prefix: str = ID_PREFIX) -> DataFrame:
    """Of a repeated generated identifier the first row keeps it and later ones become missing; `duplicate` flags
    repeats of any other identifier, which are errors.

    The first row of each identifier is found by aggregation and joined on the row position, which is unique, so an
    identifier copied to a third of all rows is no hot key.
    """
    named = rows.withColumn("instance_id", F.when(F.col("instance_id") != "", F.col("instance_id")))
    first = named.where("instance_id is not null").groupBy("instance_id").agg(F.min("row_pos").alias("row_pos"))
    marked = named.join(first.select("row_pos", F.lit(True).alias("__first")), "row_pos", "left")
    repeat = F.col("instance_id").isNotNull() & F.col("__first").isNull()
    generated = is_generated(F.col("instance_id"), prefix)
    return marked.withColumns(
        {
            "duplicate": repeat & ~generated,
            "instance_id": F.when(~(repeat & generated), F.col("instance_id")),
        }
    ).drop("__first")


def generate_ids(rows: DataFrame, *, prefix: str = ID_PREFIX, used: DataFrame | None = None) -> DataFrame:
    """Give rows without an identifier the next `prefix_N` after the largest one in use, in row order.

    `used` holds further identifiers that stay taken, such as those of linked tables.
    """
    cleaned = dedupe_generated_ids(rows, prefix)
    taken = cleaned.select("instance_id")
    if used is not None:
        taken = taken.unionByName(used.select(F.col("instance_id").cast("string").alias("instance_id")))
    following = taken.agg(F.coalesce(F.max(generated_suffix(F.col("instance_id"), prefix)) + 1, F.lit(0))).scalar()
    missing = number_rows(cleaned.where("instance_id is null").select("row_pos"), "row_pos", "__n")
    fresh = F.concat(F.lit(f"{prefix}_"), (F.col("__n") + following).cast("string"))
    return cleaned.join(missing, "row_pos", "left").withColumn(
        "instance_id", F.coalesce(F.col("instance_id"), fresh)
    ).drop("__n")


def generate_integer_ids(rows: DataFrame, *, used: DataFrame | None = None) -> DataFrame:
    """The same for integer identities: the next integers after the largest one in use."""
    taken = rows.select(F.col("instance_id").cast("long").alias("instance_id"))
    if used is not None:
        taken = taken.unionByName(used.select(F.col("instance_id").cast("long").alias("instance_id")))
    following = taken.agg(F.coalesce(F.max("instance_id") + 1, F.lit(0))).scalar()
    missing = number_rows(rows.where("instance_id is null").select("row_pos"), "row_pos", "__n")
    return rows.join(missing, "row_pos", "left").withColumn(
        "instance_id", F.coalesce(F.col("instance_id"), F.col("__n") + following)
    ).drop("__n")
