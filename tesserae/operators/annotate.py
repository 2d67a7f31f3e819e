"""Setting, removing and summarising annotations on table rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["region", "instance_id"]

# Columns owned by object classification.
USER_CLASS = "user_class"
OWNED_COLUMNS = ("user_class", "pred_class", "pred_confidence")
CLASSIFIER_COLUMNS = ("pred_class", "pred_confidence")


def check_class_id(class_id: int | None) -> None:
    if class_id is not None and (isinstance(class_id, bool) or not isinstance(class_id, int) or class_id <= 0):
        raise ValueError("Class ids must be positive integers.")


def check_target_column(obs: DataFrame, column: str, mode: str) -> None:
    """Existing columns must exist and not belong to the classifier; new ones must be free and not reserved."""
    if mode not in ("existing", "new"):
        raise ValueError("The column mode is `existing` or `new`.")
    if column in KEYS:
        raise ValueError(f"Column {column} links the table and cannot hold annotations.")
    if mode == "existing":
        if column not in obs.columns:
            raise ValueError(f"Column {column} does not exist.")
        if column in CLASSIFIER_COLUMNS:
            raise ValueError(f"Column {column} belongs to the classifier.")
    else:
        if column in OWNED_COLUMNS:
            raise ValueError(f"Column {column} is reserved for object classification.")
        if column in obs.columns:
            raise ValueError(f"Column {column} already exists.")


def check_value(obs: DataFrame, column: str, value: str | int | None, mode: str) -> str | int | None:
    if value is None:
        if mode == "new":
            raise ValueError("There is nothing to remove from a new column.")
        return None
    if isinstance(value, str):
        value = value.strip()
        if not value:
            raise ValueError("An annotation value must not be empty.")
    elif isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ValueError("An annotation value is text or a positive integer.")
    if mode == "existing":
        wants_text = obs.schema[column].dataType.simpleString() == "string"
        if wants_text != isinstance(value, str):
            raise ValueError("The annotation value does not match the type of its column.")
    return value


def _typed(value: str | int | None, obs: DataFrame, column: str) -> Column:
    if column in obs.columns:
        return F.lit(value).cast(obs.schema[column].dataType)
    return F.lit(value).cast("long") if isinstance(value, int) else F.lit(value).cast("string")


def _current(obs: DataFrame, column: str, value: str | int | None) -> Column:
    return F.col(column) if column in obs.columns else F.lit(None).cast("long" if isinstance(value, int) else "string")


def annotation_effect(matched: DataFrame, column: str, value: str | int | None) -> DataFrame:
    """Matched rows split into missing, equal and other for the proposed value (None removes), and what would change."""
    current = _current(matched, column, value)
    equal = F.lit(False) if value is None else F.coalesce(current == _typed(value, matched, column), F.lit(False))
    counts = matched.agg(
        F.count(F.lit(1)).alias("matched"), F.count_if(current.isNull()).alias("missing"), F.count_if(equal).alias("equal"),
        F.count_if(current.isNotNull() & ~equal).alias("other"),
    )
    zero = F.lit(0).cast("long")
    removal = value is None
    return counts.withColumns(
        {
            "changed": F.col("other") if removal else F.col("missing") + F.col("other"),
            "unchanged": F.col("missing") if removal else F.col("equal"),
            "overwritten": zero if removal else F.col("other"),
            "removed": F.col("other") if removal else zero,
        }
    )


def set_user_class(obs: DataFrame, chosen: DataFrame, class_id: int | None, column: str = USER_CLASS) -> DataFrame:
    """Set or clear the class of the chosen `(region, instance_id)` rows.

    The column is created on the first assignment; clearing an absent column changes nothing.
    """
    check_class_id(class_id)
    if column not in obs.columns and class_id is None:
        return obs
    marked = obs.join(chosen.select(*KEYS).distinct().withColumn("__chosen", F.lit(True)), KEYS, "left")
    value = F.when(F.col("__chosen"), F.lit(class_id).cast("long")).otherwise(_current(obs, column, 1).cast("long"))
    return marked.withColumn(column, value).drop("__chosen")


def change_count(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Rows whose value differs; zero means that the write can be skipped."""
    old = before.select(*KEYS, (F.col(column) if column in before.columns else F.lit(None)).alias("__old"))
    return after.join(old, KEYS).agg(F.count_if(~F.col(column).eqNullSafe(F.col("__old"))).alias("changed"))


def query_ids_to_rows(obs: DataFrame, matched: DataFrame) -> DataFrame:
    """Table rows of matched ids."""
    return obs.join(matched.select(*KEYS).distinct(), KEYS)


def unresolved_ids(obs: DataFrame, matched: DataFrame) -> DataFrame:
    """Matched ids that the table does not hold; must be empty before annotating."""
    return matched.select(*KEYS).distinct().join(obs.select(*KEYS), KEYS, "left_anti")


def annotate_matched(obs: DataFrame, matched: DataFrame, column: str, value: str | int | None, mode: str = "existing") -> DataFrame:
    """Set or remove a value on matched rows; all other rows stay as they are."""
    check_target_column(obs, column, mode)
    value = check_value(obs, column, value, mode)
    marked = obs.join(matched.select(*KEYS).distinct().withColumn("__matched", F.lit(True)), KEYS, "left")
    new = F.when(F.col("__matched"), _typed(value, obs, column)).otherwise(_current(obs, column, value))
    return marked.withColumn(column, new).drop("__matched")


def annotate_flagged(obs: DataFrame, flag: str, column: str, value: str | int | None, mode: str = "existing") -> DataFrame:
    """Set or remove a value on the rows whose column `flag` is true, which goes; no join is needed."""
    check_target_column(obs, column, mode)
    value = check_value(obs, column, value, mode)
    new = F.when(F.col(flag), _typed(value, obs, column)).otherwise(_current(obs, column, value))
    return obs.withColumn(column, new).drop(flag)


@dataclass(frozen=True)
class PreparedAnnotation:
    """What an annotation was prepared from: matched ids with their values then, and the inputs' identities."""

    snapshot: DataFrame
    column: str
    mode: str
    digest: str
    signature: str


def snapshot_of(obs: DataFrame, matched: DataFrame, column: str, value: str | int | None = None) -> DataFrame:
    rows = query_ids_to_rows(obs, matched)
    return rows.select(*KEYS, _current(rows, column, value).alias("prepared"), *[c for c in ("cz", "cy", "cx") if c in rows.columns])


def guard_problems(obs: DataFrame, prepared: PreparedAnnotation, *, digest: str, signature: str, cache_state: str) -> DataFrame:
    """Everything that changed since preparation, as `(check, violations)` rows."""
    current = F.col(prepared.column) if prepared.column in obs.columns else F.lit(None)
    live = obs.select(*KEYS, F.lit(True).alias("__live"), current.alias("__value"), *[F.col(c).alias(f"__{c}") for c in ("cz", "cy", "cx") if c in obs.columns])
    joined = prepared.snapshot.join(live, KEYS, "left")
    axes = [c for c in ("cz", "cy", "cx") if c in prepared.snapshot.columns and f"__{c}" in joined.columns]
    moved = F.lit(False)
    for c in axes:
        moved = moved | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    found = joined.agg(
        F.count_if(F.col("__live").isNull()).alias("rows"), F.count_if(~F.col("prepared").eqNullSafe(F.col("__value"))).alias("values"),
        F.count_if(F.col("__live").isNotNull() & moved).alias("centers"),
    )
    fixed = {
        "binding": digest != prepared.digest, "signature": signature != prepared.signature, "cache": cache_state != "valid",
        "column": (prepared.column in obs.columns) != (prepared.mode == "existing"),
    }
    rows = [F.struct(F.lit(c).alias("check"), F.col(c).alias("violations")) for c in ("rows", "values", "centers")]
    rows += [F.struct(F.lit(c).alias("check"), F.lit(int(bad)).cast("long").alias("violations")) for c, bad in fixed.items()]
    return found.select(F.inline(F.array(*rows)))


def annotate_guarded(
    obs: DataFrame, prepared: PreparedAnnotation, value: str | int | None, expected: dict[str, int], *,
    digest: str, signature: str, cache_state: str,
) -> DataFrame:
    """Annotate only if nothing changed since preparation and the effect is still the reviewed one."""
    problems = guard_problems(obs, prepared, digest=digest, signature=signature, cache_state=cache_state)
    broken = [r["check"] for r in problems.where("violations > 0").collect()]
    if broken:
        raise ValueError(f"The annotation inputs changed after preparation: {', '.join(broken)}.")
    effect = annotation_effect(
        prepared.snapshot.withColumnRenamed("prepared", prepared.column) if prepared.mode == "existing" else prepared.snapshot.drop("prepared"),
        prepared.column, value,
    ).first().asDict()
    if any(effect[k] != v for k, v in expected.items()):
        raise ValueError("The expected annotation effect does not match the prepared values.")
    if effect["changed"] == 0:
        return obs
    return annotate_matched(obs, prepared.snapshot, prepared.column, value, prepared.mode)
