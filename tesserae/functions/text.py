"""String columns: label normalisation, names, titles and generated identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the blanks that a label is trimmed of (Unicode white space plus the four separators 0x1c-0x1f).
BLANKS = r"[\s\x1c-\x1f]+"


def normalize_label(label: Column) -> Column:
    """Trim blanks at both ends; case and inner blanks stay. `trim` alone would only remove U+0020."""
    return F.regexp_replace(label, f"(?U)^{BLANKS}|{BLANKS}$", "")


def label_empty(label: Column) -> Column:
    """True for a present label that has nothing left after trimming. Most labels start with a printable ASCII
    character, which settles it without a pattern."""
    blank = label.rlike(rf"(?U)^({BLANKS})?$")
    return F.coalesce(F.when(F.ascii(label).between(33, 126), F.lit(False)).otherwise(blank), F.lit(False))


def folded_name(name: Column) -> Column:
    """Element names are unique ignoring case."""
    return F.lower(name)


def generated_suffix(value: Column, prefix: str) -> Column:
    """The number N of an identifier `prefix_N`, null for any other identifier; a number beyond 64 bits fails the query."""
    digits = F.regexp_extract(value, rf"^\Q{prefix}_\E(\d+)$", 1)
    number = digits.try_cast("bigint")
    too_large = F.raise_error(F.concat(F.lit("The number of a generated identifier is too large: "), value)).cast("bigint")
    return F.when(F.length(digits) > 0, F.coalesce(number, too_large))


def is_generated(value: Column, prefix: str) -> Column:
    return F.coalesce(value.rlike(rf"^\Q{prefix}_\E\d+$"), F.lit(False))


def tile_name(level: int | Column, tile_x: Column, tile_y: Column) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.concat_ws("/", level.cast("string"), tile_x.cast("string"), tile_y.cast("string"))


def selection_title(points_name: Column, index_column: Column, n_values: Column, mode: Column, only: Column) -> Column:
    """Title of a point selection: none, all, one named value, or a count of values."""
    tail = (
        F.when(n_values == 0, F.concat(F.lit("no "), index_column, F.lit(" values")))
        .when(mode == "all", F.concat(F.lit("all "), index_column, F.lit(" values")))
        .when(n_values == 1, F.concat(index_column, F.lit("="), only))
        .otherwise(F.concat(n_values.cast("string"), F.lit(" "), index_column, F.lit(" values")))
    )
    return F.concat(points_name, F.lit(": "), tail)


def styled_title(labels_name: Column, source_kind: Column, key: Column) -> Column:
    """`labels[obs:column]` for a table column, `labels[X:variable]` for a matrix variable."""
    family = F.when(source_kind == "obs_column", F.lit("obs")).otherwise(F.lit("X"))
    return F.concat(labels_name, F.lit("["), family, F.lit(":"), key, F.lit("]"))


def thousands(count: Column) -> Column:
    return F.format_number(count.cast("long"), 0)


def sampling_warning(loaded: Column, total: Column, budget: Column) -> Column:
    # fixed value: the wording is part of the output
    return F.concat(
        F.lit("Showing "), thousands(loaded), F.lit(" of "), thousands(total),
        F.lit(" selected points because the render point budget is "), thousands(budget), F.lit("."),
    )


def utc_stamp() -> Column:
    """ISO-8601 UTC stamp of the running query."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
