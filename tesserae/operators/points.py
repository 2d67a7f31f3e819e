"""Points: validation, value dictionaries, encoding and budgeted selection."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.numeric import finite_or_null, is_finite
from tesserae.functions.text import label_empty, normalize_label, sampling_warning
from tesserae.scale import ROWS_PER_RANGE, Sized, cumulate, join_sized, measure, order_splits, settle
from tesserae.sources.points import PointColumns

UINT32_MAX = 4294967295
DEFAULT_BUDGET = 100_000
DEFAULT_SEED = 42
FEW_LABELS = 64
NAMED_UNKNOWN = 100


def problem_of(rules: list[tuple[Column, str]]) -> Column:
    """Name of the first broken rule, null when all hold."""
    found = F.lit(None).cast("string")
    for broken, name in reversed(rules):
        found = F.when(broken, F.lit(name)).otherwise(found)
    return found


def _point_rules(columns: PointColumns) -> list[tuple[Column, str]]:
    rules = [
        (F.col("n_points") == 0, "empty"),
        (F.col("bad_x") > 0, "bad_x"),
        (F.col("bad_y") > 0, "bad_y"),
        (F.col("missing_label") > 0, "missing_label"),
        (F.col("empty_label") > 0, "empty_label"),
    ]
    if columns.points_id:
        rules += [
            (F.col("missing_id") > 0, "missing_id"),
            (F.col("distinct_ids") != F.col("n_points"), "duplicate_id"),
        ]
    return rules


def validate_points(df: DataFrame, columns: PointColumns) -> DataFrame:
    """One row of counts from one scan, plus `problem`: the first broken rule, or null."""
    label = F.col(columns.label)
    counts = [
        F.count(F.lit(1)).alias("n_points"),
        F.count_if(~is_finite(F.col(columns.x))).alias("bad_x"),
        F.count_if(~is_finite(F.col(columns.y))).alias("bad_y"),
        F.count_if(label.isNull()).alias("missing_label"),
        F.count_if(label_empty(label)).alias("empty_label"),
    ]
    if columns.points_id:
        counts += [
            F.count_if(F.col(columns.points_id).isNull()).alias("missing_id"),
            F.count_distinct(columns.points_id).alias("distinct_ids"),
        ]
    return df.agg(*counts).withColumn("problem", problem_of(_point_rules(columns)))


def require_valid_points(df: DataFrame, columns: PointColumns) -> int:
    """Raise on the first broken rule, else return the number of points."""
    row = validate_points(df, columns).first()
    if row["problem"]:
        raise ValueError(f"Points are invalid: {row['problem']} ({row.asDict()}).")
    return row["n_points"]


@dataclass(frozen=True)
class ValueDictionary:
    """Distinct normalised labels with dense ids (`value_id, value, n_points`) and the raw spellings they cover."""

    raw: Sized
    values: DataFrame

    @property
    def label_map(self) -> Sized:
        """`raw -> (value, value_id)`: joining on the raw label spares a regular expression per point."""
        mapped = self.raw.df.select("raw", normalize_label(F.col("raw")).alias("value")).join(
            self.values.select("value", "value_id"), "value"
        )
        return Sized(mapped, self.raw.rows, 2 * self.raw.nbytes + 16 * self.raw.rows)


def number_values(counts: DataFrame, bound: int | None) -> DataFrame:
    """Dense ids 0..n-1 by code point order. `bound` is a known upper limit of the rows, if any."""
    if bound is not None and bound <= ROWS_PER_RANGE:
        return cumulate(counts, "value", "value_id")
    sized = settle(counts)
    if sized.rows > UINT32_MAX + 1:
        raise ValueError("Too many distinct values for 32-bit identifiers.")
    return cumulate(sized.df, "value", "value_id", splits=order_splits(sized, "value"))


def value_dictionary(df: DataFrame, label: str) -> ValueDictionary:
    """Count labels in one scan. Spellings are counted raw and normalised afterwards, on the few distinct ones."""
    raw = settle(df.groupBy(F.col(label).alias("raw")).agg(F.count(F.lit(1)).alias("n_points")))
    counts = (
        raw.df.groupBy(normalize_label(F.col("raw")).alias("value"))
        .agg(F.sum("n_points").alias("n_points"))
        .where("n_points > 0")
    )
    values = number_values(counts, raw.rows).select("value_id", "value", "n_points")
    return ValueDictionary(raw, values)


def dictionary_total_matches(values: DataFrame, n_points: int) -> DataFrame:
    """The dictionary must account for every point of the source."""
    return values.agg(F.sum("n_points").alias("total")).select(
        "total", (F.coalesce("total", F.lit(0)) == n_points).alias("matches")
    )


def profile_points(df: DataFrame, columns: PointColumns) -> Sized:
    """Per raw label: point count, bad coordinates and bounds, from the one scan that later steps roll up."""
    x, y = F.col(columns.x), F.col(columns.y)
    return settle(
        df.groupBy(F.col(columns.label).alias("raw")).agg(
            F.count(F.lit(1)).alias("n_points"),
            F.count_if(~is_finite(x)).alias("bad_x"),
            F.count_if(~is_finite(y)).alias("bad_y"),
            F.min(finite_or_null(x)).alias("min_x"), F.max(finite_or_null(x)).alias("max_x"),
            F.min(finite_or_null(y)).alias("min_y"), F.max(finite_or_null(y)).alias("max_y"),
        )
    )


def validation_of_profile(profile: DataFrame, columns: PointColumns) -> DataFrame:
    """Validation counts and bounds rolled up from `profile_points`."""
    plain = PointColumns(columns.x, columns.y, columns.label)
    return profile.agg(
        F.coalesce(F.sum("n_points"), F.lit(0)).alias("n_points"),
        F.coalesce(F.sum("bad_x"), F.lit(0)).alias("bad_x"),
        F.coalesce(F.sum("bad_y"), F.lit(0)).alias("bad_y"),
        F.coalesce(F.sum(F.when(F.col("raw").isNull(), F.col("n_points"))), F.lit(0)).alias("missing_label"),
        F.coalesce(F.sum(F.when(label_empty(F.col("raw")), F.col("n_points"))), F.lit(0)).alias("empty_label"),
        F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"),
        F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"),
    ).withColumn("problem", problem_of(_point_rules(plain)))


def dictionary_of_profile(profile: Sized) -> ValueDictionary:
    counts = (
        profile.df.groupBy(normalize_label(F.col("raw")).alias("value"))
        .agg(F.sum("n_points").alias("n_points"))
        .where("n_points > 0")
    )
    return ValueDictionary(profile, number_values(counts, profile.rows).select("value_id", "value", "n_points"))


def requested_values(values: DataFrame, requested: DataFrame | Sequence[str]) -> DataFrame:
    """Distinct normalised requests as one `value` column."""
    if isinstance(requested, DataFrame):
        wanted = requested.select(normalize_label(F.col(requested.columns[0])).alias("value"))
    else:
        wanted = values.sparkSession.createDataFrame([(v,) for v in requested], "value string").select(
            normalize_label(F.col("value")).alias("value")
        )
    return wanted.distinct()


def unknown_values(values: DataFrame, requested: DataFrame | Sequence[str]) -> DataFrame:
    """Requested values that the dictionary does not hold."""
    return requested_values(values, requested).join(values, "value", "left_anti")


def resolve_values(dictionary: ValueDictionary, requested: DataFrame | Sequence[str] | str) -> DataFrame:
    """Dictionary rows of a request, by value id; the word `all` asks for every value."""
    if isinstance(requested, str):
        if requested != "all":
            raise ValueError("Ask for a sequence of values or for 'all'.")
        return dictionary.values
    return dictionary.values.join(requested_values(dictionary.values, requested), "value", "left_semi").select(
        "value_id", "value", "n_points"
    )


def require_known_values(dictionary: ValueDictionary, requested: DataFrame | Sequence[str]) -> None:
    missing = unknown_values(dictionary.values, requested)
    number = missing.count()
    if number:
        named = [repr(row[0]) for row in missing.orderBy("value").take(NAMED_UNKNOWN)]
        rest = f" and {number - len(named)} more" if number > len(named) else ""
        raise ValueError(f"The dictionary lacks {number} requested value(s): {', '.join(named)}{rest}.")


def filter_by_values(
    df: DataFrame, columns: PointColumns, dictionary: ValueDictionary, selected: DataFrame
) -> DataFrame:
    """Points whose normalised label is selected: `y, x, label, value_id` (plus the identity column, if named).

    The selected spellings are joined, broadcast if small. When there are only a few, they also become a plain
    filter that reaches the parquet scan.
    """
    spellings = settle(
        dictionary.label_map.df.join(selected.select("value_id"), "value_id", "left_semi").select(
            F.col("raw").alias(columns.label), "value", "value_id"
        )
    )
    keep = [columns.y, columns.x] + ([columns.points_id] if columns.points_id else [])
    points = df
    if spellings.rows <= FEW_LABELS:
        points = df.where(F.col(columns.label).isin([r[0] for r in spellings.df.select(columns.label).collect()]))
    return join_sized(points.select(*columns.names()), spellings, columns.label).select(
        *keep, F.col("value").alias(columns.label), "value_id"
    )


def encode_labels(
    df: DataFrame, columns: PointColumns, dictionary: ValueDictionary, id_name: str = "gene_id"
) -> DataFrame:
    """Replace the label by its dense id, name the coordinates x and y, keep the identity column.

    A label outside the dictionary stops the job.
    """
    if id_name in df.columns:
        raise ValueError(f"Points already contain the reserved column {id_name}.")
    spellings = dictionary.label_map
    mapped = Sized(
        spellings.df.select(F.col("raw").alias(columns.label), "value_id"), spellings.rows, spellings.nbytes
    )
    joined = join_sized(df.select(*columns.names()), mapped, columns.label, "left")
    found = F.when(F.col("value_id").isNotNull(), F.col("value_id")).otherwise(
        F.raise_error(F.lit("A label is missing from the dictionary.")).cast("long")
    )
    keep = [F.col(columns.points_id)] if columns.points_id else []
    return joined.select(F.col(columns.x).alias("x"), F.col(columns.y).alias("y"), found.alias(id_name), *keep)


def join_dictionary(facts: DataFrame, label: str, values: DataFrame | Sized) -> DataFrame:
    """Attach `value_id` to every fact row by equality of an already normalised label."""
    sized = values if isinstance(values, Sized) else measure(values.select("value", "value_id"))
    keyed = Sized(sized.df.select(F.col("value").alias(label), "value_id"), sized.rows, sized.nbytes)
    return join_sized(facts, keyed, label)


def sort_selection(selected: DataFrame) -> DataFrame:
    return selected.orderBy("value_id")


@dataclass(frozen=True)
class Selection:
    """Selected points (float coordinates) and how they relate to the full selection."""

    points: DataFrame
    total_count: int
    budget: int
    is_sampled: bool

    def summary(self) -> DataFrame:
        """Loaded and total counts, and the warning text of a sampled selection."""
        loaded = self.points.agg(F.count(F.lit(1)).alias("loaded_count"))
        warning = sampling_warning(F.col("loaded_count"), F.lit(self.total_count), F.lit(self.budget))
        return loaded.select(
            "loaded_count", F.lit(self.total_count).cast("long").alias("total_count"),
            F.lit(self.budget).cast("long").alias("budget"), F.lit(self.is_sampled).alias("is_sampled"),
            (warning if self.is_sampled else F.lit(None).cast("string")).alias("warning"),
        )


def select_within_budget(
    df: DataFrame,
    columns: PointColumns,
    dictionary: ValueDictionary,
    requested: DataFrame | Sequence[str] | str = "all",
    *,
    budget: int = DEFAULT_BUDGET,
    seed: int = DEFAULT_SEED,
) -> Selection:
    """All selected points, or a seeded sample of at most `budget` of them.

    The total is known from the dictionary, so a sample is thinned to little more than `budget` rows while scanning; only
    that remainder is ordered to cut it to size. With an identity column the choice depends on it and on the
    seed alone; without one it also depends on the partitioning, as repeated points can't be told apart.
    """
    if isinstance(budget, bool) or not isinstance(budget, int) or budget <= 0:
        raise ValueError("The render point budget must be a positive integer.")
    if not isinstance(requested, str):
        require_known_values(dictionary, requested)
    selected = resolve_values(dictionary, requested)
    total = selected.agg(F.sum("n_points")).first()[0] or 0
    points = filter_by_values(df, columns, dictionary, selected)
    sampled = total > budget
    if sampled:
        # thinned to a little more than the budget (six standard deviations), so that the cut gives its exact size
        fraction = (budget + 6 * math.sqrt(budget)) / total
        key = [columns.points_id] if columns.points_id else [columns.y, columns.x, F.monotonically_increasing_id()]
        priority = F.xxhash64(*key, F.lit(seed))
        cut = min(int(-(2**63) + fraction * 2**64), 2**63 - 1)
        points = points.withColumn("__priority", priority).where(F.col("__priority") <= F.lit(cut))
        points = points.orderBy("__priority", columns.y, columns.x).limit(budget).drop("__priority")
    points = points.withColumns({c: F.col(c).cast("float") for c in (columns.y, columns.x)})
    return Selection(points, int(total), budget, sampled)
