"""From table values to codes and colors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.numeric import clip, finite_or_null, is_finite, unit_position
from tesserae.functions.palette import (
    DISTINCT_COLORS, NEUTRAL_COLOR, SOLID_POINT_COLOR, color_value, default_color, is_color,
)
from tesserae.scale import Sized, join_sized, number_rows, settle

# A text column is called high-cardinality above the larger of the two.
MANY_VALUES = 20
ROWS_PER_VALUE = 100

# The code of the background and the first one of a category; 0 is left to objects without a table row.
BACKGROUND_CODE, FIRST_CODE = 1, 2

HELPER_SUFFIXES = ("_colors", "_color", ".color")


def classify_column_kind(
    df: DataFrame, *, categorical: Sequence[str] = (), instance_key: str | None = None,
    skip: Sequence[str] = (), shape_columns: bool = False,
) -> DataFrame:
    """`(column, kind)`: categorical, continuous, instance or none, from types and one aggregate over all columns."""
    names = [c for c in df.columns if c not in skip and not (shape_columns and c.endswith(HELPER_SUFFIXES))]
    facts: list[Column] = []
    for c in names:
        facts.append(F.count(F.col(c)).alias(f"n:{c}"))
        if isinstance(df.schema[c].dataType, T.IntegralType):
            facts += [
                F.min(c).alias(f"lo:{c}"), F.max(c).alias(f"hi:{c}"),
                F.count_if(~F.col(c).isin(0, 1)).alias(f"other:{c}"),
            ]

    def kind(c: str) -> Column:
        dtype, n = df.schema[c].dataType, F.col(f"`n:{c}`")
        if c == instance_key:
            return F.lit("instance")
        if c in categorical:
            return F.lit("categorical")
        if isinstance(dtype, T.IntegralType):
            binary = (F.col(f"`lo:{c}`") == 0) & (F.col(f"`hi:{c}`") == 1) & (F.col(f"`other:{c}`") == 0)
            known = F.when(binary, "categorical").otherwise("continuous")
        elif isinstance(dtype, (T.BooleanType, T.StringType)):
            known = F.lit("categorical")
        elif isinstance(dtype, T.NumericType):
            known = F.lit("continuous")
        else:
            known = F.lit("none")
        return F.when(n > 0, known).otherwise("none")

    rows = F.array(*[F.struct(F.lit(c).alias("column"), kind(c).alias("kind")) for c in names])
    return df.agg(*facts).select(F.inline(rows))


def first_seen_categories(df: DataFrame, value: str, row_pos: str = "row_pos") -> DataFrame:
    """Distinct values numbered from zero by first appearance; needs an explicit row position."""
    seen = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("category")).agg(F.min(row_pos).alias("first_pos"))
    return number_rows(seen, "first_pos", "pos").select("pos", "category")


def typed_category_values(df: DataFrame, column: str, *, vocabulary: DataFrame | None = None, row_pos: str = "row_pos") -> DataFrame:
    """Ordered categories of a column by its type, as `(pos, category)` with text categories.

    A declared vocabulary is taken as it is; booleans and 0/1 integers list the values present; text goes by first
    appearance. Other types are continuous and have none.
    """
    dtype = df.schema[column].dataType
    if vocabulary is not None:
        return vocabulary.select("pos", F.col("category").cast("string").alias("category"))
    if isinstance(dtype, T.StringType):
        return first_seen_categories(df, column, row_pos)
    if isinstance(dtype, T.BooleanType):
        options = [(F.col(column) == False, "false"), (F.col(column) == True, "true")]  # noqa: E712
    elif isinstance(dtype, T.IntegralType):
        options = [(F.col(column) == 0, "0"), (F.col(column) == 1, "1")]
    else:
        raise ValueError(f"Column {column} is continuous and has no categories.")
    present = df.agg(*[F.coalesce(F.bool_or(test), F.lit(False)).alias(f"has{i}") for i, (test, _) in enumerate(options)])
    listed = F.filter(
        F.array(*[F.when(F.col(f"has{i}"), F.lit(name)) for i, (_, name) in enumerate(options)]), lambda v: v.isNotNull()
    )
    return present.select(F.posexplode(listed).alias("pos", "category")).withColumn("pos", F.col("pos").cast("long"))


def high_cardinality(df: DataFrame, value: str) -> DataFrame:
    """Whether a text column has more distinct values than the viewer treats as categories without a warning."""
    counts = df.agg(F.count_distinct(value).alias("n_values"), F.count(F.lit(1)).alias("n_rows"))
    limit = F.greatest(F.lit(MANY_VALUES).cast("long"), F.floor(F.col("n_rows") / ROWS_PER_VALUE))
    return counts.select("n_values", limit.alias("threshold"), (F.col("n_values") > limit).alias("is_high"))


def same_color(color: Column) -> Column:
    """Colors by value; what is no color keeps its spelling."""
    return F.coalesce(color_value(color), color)


def companion_palette(df: DataFrame, categories: DataFrame, value: str, color: str | None) -> DataFrame:
    """`(pos, category, color, source)`: the companion colors if each category has exactly one valid color,
    else the default palette for all categories."""
    if color is None:
        return categories.select(
            "pos", "category", default_color(F.col("pos") + 1).alias("color"), F.lit("default_missing").alias("source")
        )
    spellings = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("category"), F.col(color).alias("color")).agg(F.lit(1).alias("one"))
    spellings = spellings.withColumn("spelled", color_value(F.col("color")))
    per_category = spellings.groupBy("category").agg(
        F.count("color").alias("n"), F.count("spelled").alias("n_valid"),
        F.min("spelled").alias("low"), F.max("spelled").alias("high"), F.min("color").alias("color"),
    )
    good = (F.col("n") > 0) & (F.col("n") == F.col("n_valid")) & (F.col("low") == F.col("high"))
    judged = join_sized(categories, settle(per_category.withColumn("good", good)), "category", "left").withColumn(
        "good", F.coalesce("good", F.lit(False))
    )
    all_good = judged.agg(F.coalesce(F.bool_and("good"), F.lit(True))).scalar()
    return judged.select(
        "pos", "category",
        F.when(all_good, F.col("color")).otherwise(default_color(F.col("pos") + 1)).alias("color"),
        F.when(all_good, F.lit("stored")).otherwise("default_invalid").alias("source"),
    )


def value_range(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.min(finite_or_null(F.col(value))).alias("lo"), F.max(finite_or_null(F.col(value))).alias("hi"))


def _with_range(df: DataFrame, value: str, fixed: tuple[float, float] | None) -> DataFrame:
    """Attach `__ends` (lo, hi) once, as a scalar subquery or a literal."""
    if fixed:
        return df.withColumn("__ends", F.struct(F.lit(float(fixed[0])).alias("lo"), F.lit(float(fixed[1])).alias("hi")))
    return df.withColumn("__ends", value_range(df, value).select(F.struct("lo", "hi")).scalar())


def normalized_values(df: DataFrame, value: str, out: str = "normalized") -> DataFrame:
    """Position of each value between the column's extremes: [0, 1], 0.5 for a constant, null when not finite."""
    ranged = _with_range(df, value, None)
    return ranged.withColumn(out, unit_position(F.col(value), F.col("__ends.lo"), F.col("__ends.hi"))).drop("__ends")


def continuous_codes(
    df: DataFrame, value: str, *, bins: int = 256, fixed_range: tuple[float, float] | None = None, out: str = "code"
) -> DataFrame:
    """Bin number plus two; missing and non-finite values share the code after the last bin."""
    if isinstance(bins, bool) or not isinstance(bins, int) or bins < 2:
        raise ValueError("Continuous codes need at least two bins.")
    if fixed_range is not None and not fixed_range[0] < fixed_range[1]:
        raise ValueError("A value range needs min < max.")
    ranged = _with_range(df, value, fixed_range)
    position = unit_position(F.col(value).cast("double"), F.col("__ends.lo"), F.col("__ends.hi"))
    code = clip(F.floor(position * bins), F.lit(0), F.lit(bins - 1)) + FIRST_CODE
    coded = F.when(is_finite(F.col(value)), code).otherwise(F.lit(bins + FIRST_CODE)).cast("long")
    return ranged.withColumn(out, coded).drop("__ends")


def color_codes(palette: DataFrame) -> Sized:
    """Each distinct color of a palette with its code, in category order; transparent is the background's code."""
    distinct = (
        palette.groupBy(same_color(F.col("color")).alias("spelled")).agg(F.min("pos").alias("first_pos"))
        .where(F.col("spelled") != "#00000000")
    )
    numbered = number_rows(distinct, "first_pos", "n").select("spelled", (F.col("n") + FIRST_CODE).alias("code"))
    return settle(numbered)


def categorical_codes(df: DataFrame, value: str, palette: DataFrame, *, missing_color: str = NEUTRAL_COLOR, out: str = "code") -> DataFrame:
    """Code of each row's category color. Categories of one color share a code; missing and unknown values share the
    code of the neutral color, which comes last unless the palette uses it."""
    codes = color_codes(palette)
    background = palette.sparkSession.createDataFrame([("#00000000", BACKGROUND_CODE)], "spelled string, code long")
    known = codes.df.unionByName(background)
    by_category = palette.withColumn("spelled", same_color(F.col("color"))).join(known, "spelled").select(
        F.col("category").alias(value), F.col("code").alias(out)
    )
    neutral = F.lit(codes.rows + FIRST_CODE)
    own = codes.df.where(F.col("spelled") == same_color(F.lit(missing_color))).agg(F.max("code")).scalar()
    return join_sized(df, by_category, value, "left").withColumn(out, F.coalesce(out, own, neutral).cast("long"))


def palette_join(df: DataFrame, value: str, palette: DataFrame, *, out: str = "color", missing_color: str = NEUTRAL_COLOR) -> DataFrame:
    """Color of each row's value; missing and unknown values get the neutral color."""
    colors = palette.select(F.col("category").alias(value), F.col("color").alias(out))
    return join_sized(df, colors, value, "left").withColumn(out, F.coalesce(out, F.lit(missing_color)))


def categorical_colors(df: DataFrame, value: str, categories: DataFrame, *, out: str = "color") -> DataFrame:
    """Default colors by category order, joined to the rows."""
    palette = categories.select("category", default_color(F.col("pos") + 1).alias("color"))
    return palette_join(df, value, palette, out=out)


def resolve_palette(vocabulary: DataFrame, stored: DataFrame) -> DataFrame:
    """`(column, pos, category, color, source)` per categorical column: stored colors when there are as many as
    categories and all are valid, else the default palette and why."""
    sizes = vocabulary.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    facts = stored.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_colors"), F.coalesce(F.bool_and(is_color(F.col("color"))), F.lit(False)).alias("valid")
    )
    source = (
        F.when(F.col("n_colors").isNull(), "default_missing")
        .when((F.col("n_colors") != F.col("n")) | ~F.col("valid"), "default_invalid").otherwise("stored")
    )
    judged = sizes.join(facts, "column", "left").select("column", source.alias("source"))
    colored = vocabulary.join(judged, "column").join(stored.select("column", "pos", F.col("color").alias("own")), ["column", "pos"], "left")
    return colored.select(
        "column", "pos", "category",
        F.when(F.col("source") == "stored", F.col("own")).otherwise(default_color(F.col("pos") + 1)).alias("color"), "source",
    )


def append_vocabulary(current: DataFrame, observed: DataFrame) -> DataFrame:
    """Current `(pos, category)` followed by the new observed categories in sorted order."""
    fresh = observed.select("category").where("category is not null").distinct().join(current, "category", "left_anti")
    size = current.agg(F.coalesce(F.max("pos") + 1, F.lit(0))).scalar()
    appended = number_rows(fresh, "category", "n").select((F.col("n") + size).alias("pos"), "category")
    return current.select("pos", "category").unionByName(appended)


def extend_palette(vocabulary: DataFrame, palette: DataFrame) -> DataFrame:
    """Colors for an appended vocabulary: existing ones stay, new ones are defaults by position."""
    return vocabulary.join(palette.select("pos", "color"), "pos", "left").select(
        "pos", "category", F.coalesce("color", default_color(F.col("pos") + 1)).alias("color")
    )


def class_difference(predicted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Predicted classes that the vocabulary does not declare."""
    return predicted.select("category").where("category is not null").distinct().join(
        vocabulary.select("category").distinct(), "category", "left_anti"
    )


def prediction_palette(predicted: DataFrame, user_palette: DataFrame) -> DataFrame:
    """Color of each predicted class: the user's color for that class, else the default of its number."""
    return predicted.join(user_palette.select("category", "color"), "category", "left").withColumn(
        "color", F.coalesce("color", default_color(F.col("category")))
    )


def instance_identity_codes(df: DataFrame, identity: str, row_pos: str = "row_pos", out: str = "code") -> DataFrame:
    """Positive integers are their own code; other identities are numbered by first appearance; missing is zero."""
    if isinstance(df.schema[identity].dataType, T.IntegralType):
        lowest = df.agg(F.min(identity)).first()[0]
        if lowest is not None and lowest > 0:
            return df.withColumn(out, F.coalesce(F.col(identity).cast("long"), F.lit(0)))
    seen = first_seen_categories(df, identity, row_pos).select(
        F.col("category").alias(identity), (F.col("pos") + 1).alias(out)
    )
    return join_sized(df, seen, identity, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def points_color_plan(selected: DataFrame) -> DataFrame:
    """Color of each selected value from `(value, use_pos)`: one solid color for no or too many values, else a color
    by order of first use, so that a value keeps its color when others are added."""
    ordered = number_rows(selected.groupBy("value").agg(F.min("use_pos").alias("use_pos")), "use_pos", "n")
    count = selected.agg(F.count_distinct("value")).scalar()
    many = count > len(DISTINCT_COLORS)
    return ordered.select(
        "value", F.when(many, F.lit(SOLID_POINT_COLOR)).otherwise(default_color(F.col("n") + 1)).alias("color"),
        F.when(many, "solid").otherwise("categorical").alias("mode"),
    )


def compatible_annotation_columns(vocabulary: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Categorical columns that can take annotations: all categories text, or all positive integers.

    `vocabulary` is `(column, category, kind)` with kind `string` or `integer`; columns named in `excluded`
    (linkage and classifier output) never qualify.
    """
    text = F.bool_and(F.col("kind") == "string")
    number = F.bool_and(F.coalesce((F.col("kind") == "integer") & (F.col("category").try_cast("bigint") > 0), F.lit(False)))
    judged = vocabulary.where(~F.col("column").isin(list(excluded))).groupBy("column").agg(text.alias("t"), number.alias("i"))
    return judged.where("t or i").select("column", F.when(F.col("t"), "string").otherwise("positive_integer").alias("value_kind"))
