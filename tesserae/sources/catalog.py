"""Element catalog: one row per element and coordinate system, with its transform and spatial size.

Columns: `element, kind, coordinate_system, a, b, d, e, xoff, yoff, zoff, nz, ny, nx`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.numeric import ABSOLUTE_TOLERANCE, RELATIVE_TOLERANCE, close, is_translation
from tesserae.functions.text import folded_name
from tesserae.scale import Sized, join_sized, settle

KINDS = ("images", "labels", "points", "shapes", "tables")
PAIRS_TOGETHER = 4_000_000


def element_catalog(catalog: DataFrame, kind: str | None = None, coordinate_system: str | None = None) -> DataFrame:
    """Elements in name order with their coordinate systems; optionally of one kind, or bound to one system."""
    if kind is not None and kind not in KINDS:
        raise ValueError(f"Element kinds are {KINDS}.")
    rows = catalog if kind is None else catalog.where(F.col("kind") == kind)
    listed = rows.groupBy("element", "kind").agg(F.sort_array(F.collect_set("coordinate_system")).alias("coordinate_systems"))
    if coordinate_system is not None:
        listed = listed.where(F.array_contains("coordinate_systems", coordinate_system))
    return listed.orderBy("element")


def coordinate_systems(*catalogs: DataFrame) -> DataFrame:
    merged = catalogs[0].select("coordinate_system")
    for other in catalogs[1:]:
        merged = merged.union(other.select("coordinate_system"))
    return merged.distinct().orderBy("coordinate_system")


def name_collisions(catalog: DataFrame) -> DataFrame:
    """Element names that are equal ignoring case."""
    names = catalog.select("element", "kind").distinct().withColumn("folded", folded_name(F.col("element")))
    return names.groupBy("folded").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def with_translation(catalog: DataFrame) -> DataFrame:
    """Flag transforms that only shift in the plane."""
    return catalog.withColumn("is_translation", is_translation(F.col("a"), F.col("b"), F.col("d"), F.col("e"), F.col("zoff")))


def labels_in_coordinate_system(catalog: DataFrame) -> DataFrame:
    """Per coordinate system, labels elements that features can be computed for, and those that cannot."""
    labels = with_translation(catalog.where("kind = 'labels'"))
    return labels.groupBy("coordinate_system").agg(
        F.count_if("is_translation").alias("eligible"), F.count_if(~F.col("is_translation")).alias("unavailable"),
        F.count(F.lit(1)).alias("total"),
    )


def _tolerance(shift: Column) -> Column:
    return F.lit(ABSOLUTE_TOLERANCE) + F.lit(RELATIVE_TOLERANCE) * F.abs(shift)


def _grain(shift: Column) -> Column:
    """Power of two, at least twice the tolerance of a shift: equal shifts differ by one grain at most."""
    return F.ceil(F.log2(2 * _tolerance(shift))).cast("int")


def _cell(shift: Column, grain: Column) -> Column:
    return F.floor(shift / F.pow(F.lit(2.0), grain))


def _cells_near(shift: Column) -> Column:
    """The cells, on the grains next to its own, of all shifts that may equal this one."""
    reach = 2 * _tolerance(shift)
    return F.flatten(F.transform(F.sequence(_grain(shift) - 1, _grain(shift) + 1), lambda grain: F.transform(
        F.sequence(_cell(shift - reach, grain), _cell(shift + reach, grain)), lambda cell: F.struct(grain.alias("grain"), cell.alias("cell")))))


SIZES = ("nz", "ny", "nx")
SHIFTS = ("a", "b", "d", "e", "xoff", "yoff", "zoff")


def _placed(catalog: DataFrame, kind: str) -> DataFrame:
    """Elements of a kind with `place`: system, size and transform. Null where these can match nothing."""
    filled = with_translation(catalog.where(F.col("kind") == kind)).withColumns({"nz": F.coalesce("nz", F.lit(0)), "zoff": F.coalesce("zoff", F.lit(0.0))})
    place = F.struct("coordinate_system", *SIZES, *[F.col(c).cast("double").alias(c) for c in SHIFTS])
    known = F.col("is_translation")
    for c in ("coordinate_system", *SIZES, *SHIFTS):
        known = known & F.col(c).isNotNull()
    return filled.select("coordinate_system", "element", F.when(known, place).alias("place"))


def _matching_places(labels: DataFrame, images: DataFrame) -> DataFrame:
    """`(label_place, image_place, n_labels, n_images)`: the places of labels and images that match, each pair once.

    Elements are counted per place first, so the work follows the different places and not the elements. Shifts are equal within
    a tolerance, so an image's place is put into the cell of a grid as fine as the tolerance, and labels look into the cells
    around theirs: images elsewhere in the same system are never paired. The join is a merge: a label's many cells don't show
    in Spark's estimate of its side, which would be taken as small enough to be sent whole.
    """
    def places(rows: DataFrame, kind: str) -> DataFrame:
        return rows.where("place IS NOT NULL").groupBy(F.col("place").alias(f"{kind}_place")).agg(F.count(F.lit(1)).alias(f"n_{kind}s"))

    left, right = places(labels, "label"), places(images, "image")
    for axis in ("xoff", "yoff"):
        shift = F.col(f"image_place.{axis}")
        right = right.withColumn(f"__{axis}", F.struct(_grain(shift).alias("grain"), _cell(shift, _grain(shift)).alias("cell")))
        left = left.withColumn(f"__{axis}", F.explode(_cells_near(F.col(f"label_place.{axis}"))))
    exact = ["coordinate_system", *SIZES]
    for c in exact:
        left, right = left.withColumn(f"__{c}", F.col(f"label_place.{c}")), right.withColumn(f"__{c}", F.col(f"image_place.{c}"))
    same = F.lit(True)
    for c in SHIFTS:
        same = same & close(F.col(f"image_place.{c}"), F.col(f"label_place.{c}"))
    found = left.join(right.hint("merge"), [*[f"__{c}" for c in exact], "__xoff", "__yoff"]).where(same)
    return found.select("label_place", "image_place", "n_labels", "n_images")


def match_images_to_labels(catalog: DataFrame) -> DataFrame:
    """`(coordinate_system, labels, image)`: same system and spatial size, both mere shifts, by the same amount.

    Places are matched first (see `_matching_places`), then their elements are paired. The labels of two places with more than
    `PAIRS_TOGETHER` pairs are spread over several groups, each with all images, so that no task makes them all.
    """
    labels, images = _placed(catalog, "labels"), _placed(catalog, "images")
    salts = F.least(F.ceil(F.col("n_labels") * F.col("n_images") / PAIRS_TOGETHER), F.col("n_labels")).alias("__salts")
    pairs = settle(_matching_places(labels, images).select("*", F.monotonically_increasing_id().alias("__pair"), salts))

    def paired(rows: DataFrame, kind: str, salt: Column, name: str) -> DataFrame:
        own = Sized(pairs.df.select(F.col(f"{kind}_place").alias("place"), "__pair", "__salts"), pairs.rows, pairs.nbytes)
        return join_sized(rows, own, "place").select("__pair", salt.alias("__salt"), F.col("coordinate_system").alias(f"__{kind}_system"), F.col("element").alias(name))

    left = paired(labels.where("place IS NOT NULL"), "label", F.pmod(F.xxhash64("element"), F.col("__salts")), "labels")
    right = paired(images.where("place IS NOT NULL"), "image", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__salts") - 1)), "image")
    both = left.join(right.hint("merge"), ["__pair", "__salt"])
    return both.select(F.col("__label_system").alias("coordinate_system"), "labels", "image")


def image_discovery(catalog: DataFrame) -> DataFrame:
    """Per labels element and coordinate system: matching images, images in the system, and the rest. Images are counted per
    place; no pair of elements is made."""
    labels, images = _placed(catalog, "labels"), _placed(catalog, "images")
    found = _matching_places(labels, images).groupBy(F.col("label_place").alias("place")).agg(F.sum("n_images").alias("matching"))
    matched = join_sized(labels, settle(found), "place", "left").groupBy("coordinate_system", F.col("element").alias("labels"))
    totals = images.groupBy("coordinate_system").agg(F.count(F.lit(1)).alias("images"))
    counted = join_sized(matched.agg(F.sum("matching").alias("matching")), settle(totals), "coordinate_system", "left")
    filled = counted.na.fill(0, ["matching", "images"])
    return filled.withColumn("unavailable", F.col("images") - F.col("matching"))
