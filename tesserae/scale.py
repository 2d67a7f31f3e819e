"""Size checks, lineage cuts and ordered numbering that hold when one key owns much of the data.

Three rules are kept in one place so that the operators stay plain DataFrame code:

* a side is broadcast only after its rows and bytes were counted (`join_sized`); past the limit the
  join shuffles both sides, with the hot keys of the larger side spread over several tasks (`spread_hot_keys`);
* lineage is cut with a reliable `checkpoint()` in the cluster's shared folder (`settle`);
* running totals and row numbers never need one task to see a whole key: the order is cut into ranges
  at known split points, each range is numbered on its own, and the range totals are added (`cumulate`).
"""

from __future__ import annotations

import math
import os
import tempfile
import zipfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 128 << 20
ROWS_PER_RANGE = 2_000_000
MAX_RANGES = 4096
HOT_ROWS = 2_000_000


@dataclass(frozen=True)
class Sized:
    """A DataFrame together with its counted rows and estimated bytes."""

    df: DataFrame
    rows: int
    nbytes: int

    @property
    def broadcastable(self) -> bool:
        return self.rows <= BROADCAST_ROWS and self.nbytes <= BROADCAST_BYTES


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the session's `spark.checkpoint.dir`; make a folder only for a local master that sets none."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a shared folder before running on a cluster.")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(configured)
    return configured


def ship_package(spark: SparkSession) -> None:
    """Send the sources of this package to the executors, once per Spark context, for functions that run in Python there."""
    context = spark.sparkContext
    if getattr(context, "_tesserae_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "tesserae.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._tesserae_shipped = True


def _width(kind: T.DataType, column: Column) -> Column:
    """Estimated bytes of a value, from lengths alone."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        total = F.lit(8 * len(kind.fields))
        for field in kind.fields:
            if not _fixed(field.dataType):
                total = total + _width(field.dataType, column[field.name])
        return total
    if isinstance(kind, T.ArrayType):
        return F.lit(16) + _elements(kind.elementType, column)
    if isinstance(kind, T.MapType):
        return F.lit(32) + _elements(kind.keyType, F.map_keys(column)) + _elements(kind.valueType, F.map_values(column))
    return F.lit(8)


def _fixed(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_fixed(field.dataType) for field in kind.fields)
    return not isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType))


def _elements(kind: T.DataType, values: Column) -> Column:
    if _fixed(kind):
        return F.coalesce(F.size(values), F.lit(0)) * (8 * len(kind.fields) if isinstance(kind, T.StructType) else 8)
    total = F.aggregate(values, F.lit(0).cast("long"), lambda sum_, v: sum_ + _width(kind, v).cast("long"))
    return F.coalesce(total, F.lit(0))


def _row_bytes(df: DataFrame) -> Column:
    total = F.lit(16)
    for field in df.schema.fields:
        total = total + _width(field.dataType, F.col(f"`{field.name}`"))
    return F.sum(total.cast("long"))


def measure(df: DataFrame) -> Sized:
    """Count rows and bytes with one aggregate job."""
    row = df.agg(F.count(F.lit(1)).alias("n"), _row_bytes(df).alias("b")).first()
    return Sized(df, int(row["n"]), int(row["b"] or 0))


def settle(df: DataFrame) -> Sized:
    """Checkpoint `df` reliably and count it during the same job."""
    ensure_checkpoint_dir(df.sparkSession)
    seen = Observation()
    fixed = df.observe(seen, F.count(F.lit(1)).alias("n"), _row_bytes(df).alias("b")).checkpoint(eager=True)
    found = seen.get
    return Sized(fixed, int(found["n"]), int(found["b"] or 0))


def spread_hot_keys(
    left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Add a `__salt` key to both sides so that no key of `left` stays in one task.

    Keys with more than `HOT_ROWS` rows get one salt for each `HOT_ROWS` of them. Their left rows are salted by the input
    partition they come from: that does not change when a task is retried, and it also separates identical copies, which
    a hash of the row would not. Their right rows are repeated per salt. The list of hot keys is broadcast: it is counted,
    and the level of heat is doubled until it is small enough. Missing keys match nothing and are spread likewise.
    `counts(keys, __n)` are the rows of each key of `left`, if they are known already; else `left` is grouped for them.
    """
    if counts is None:
        counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    hot, level = settle(counts.where(F.col("__n") > HOT_ROWS)), HOT_ROWS
    while not hot.broadcastable:
        level *= 2
        hot = settle(hot.df.where(F.col("__n") > level))
    listed = F.broadcast(hot.df.select(*keys, F.ceil(F.col("__n") / HOT_ROWS).cast("int").alias("__salts")))
    part = F.spark_partition_id()
    absent = F.lit(False)
    for key in keys:
        absent = absent | F.col(key).isNull()
    salted = left.join(listed, keys, "left").withColumn(
        "__salt", F.when(absent, part).when(F.col("__salts") > 1, F.pmod(part, F.col("__salts"))).otherwise(F.lit(0))
    ).drop("__salts")
    repeats = F.when(F.col("__salts") > 1, F.sequence(F.lit(0), F.col("__salts") - 1)).otherwise(F.array(F.lit(0)))
    repeated = right.join(listed, keys, "left").withColumn("__salt", F.explode(repeats)).drop("__salts")
    return salted, repeated


def join_sized(
    left: DataFrame, right: DataFrame | Sized, on: str | list[str], how: str = "inner", counts: DataFrame | None = None
) -> DataFrame:
    """Join, broadcasting `right` only when it was counted and is small; else a shuffle join with hot keys spread."""
    sized = right if isinstance(right, Sized) else measure(right)
    if sized.broadcastable:
        return left.join(F.broadcast(sized.df), on, how)
    keys = [on] if isinstance(on, str) else list(on)
    salted, repeated = spread_hot_keys(left, sized.df, keys, counts)
    return salted.join(repeated, [*keys, "__salt"], how).drop("__salt")


def _string_splits(df: DataFrame, column: str, ranges: int, rows: int) -> list[str]:
    """About `ranges` split points of a column of distinct strings, picked by hash, so they are repeatable."""
    keep = F.pmod(F.xxhash64(F.col(column)), F.lit(max(1, rows // ranges))) == 0
    return sorted(row[0] for row in df.where(keep).select(column).collect())  # about `ranges` of them


def order_splits(source: DataFrame | Sized, column: str, rows_per_range: int | None = None) -> list:
    """Split points of an order column such that no range holds much more than `rows_per_range` rows.

    Numbers use approximate quantiles, strings (which must be distinct) a hash-chosen subset. At most a few
    thousand values reach the driver; a small input needs none and gets an empty list.
    """
    rows_per_range = rows_per_range or ROWS_PER_RANGE
    if isinstance(source, Sized):
        df, rows = source.df, source.rows
    else:
        df, rows = source, source.count()
    ranges = min(MAX_RANGES, math.ceil(rows / rows_per_range))
    if ranges <= 1:
        return []
    if isinstance(df.schema[column].dataType, T.StringType):
        return _string_splits(df, column, ranges, rows)
    probabilities = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.percentile_approx(column, probabilities, 10 * ranges).alias("q")).first()["q"] or []
    return sorted(set(found))


def range_of(column: Column, splits: list) -> Column:
    """Number of split points at or below `column`, by a two-step search over literal arrays."""
    if not splits:
        return F.lit(0)
    step = max(1, math.isqrt(len(splits)))
    blocks = [splits[i : i + step] for i in range(0, len(splits), step)]

    def at_or_below(values: Column) -> Column:
        return F.size(F.filter(values, lambda split: split <= column))

    if len(blocks) == 1:
        return at_or_below(F.lit(splits))
    block = F.greatest(at_or_below(F.lit([b[0] for b in blocks])), F.lit(1))
    inner = F.array(*[F.lit(b) for b in blocks])
    return (block - 1) * step + at_or_below(F.element_at(inner, block))


def cumulate(
    df: DataFrame,
    order: str,
    out: str,
    *,
    keys: list[str] | None = None,
    weight: str | None = None,
    splits: list | None = None,
    ties: list[str] | None = None,
) -> DataFrame:
    """Add `out`: over the earlier rows of the same key, in `order`, their number or the sum of `weight`.

    With split points, a key's rows are spread over (key, range) groups and a small table of range totals
    supplies the offsets, so a key that owns a third of the data is still handled by many tasks. `order`, with
    the columns of `ties`, must be unique within a key for the numbering to be well defined.
    """
    keys, ties = list(keys or []), list(ties or [])

    def total(column: str | None) -> Column:
        return F.count(F.lit(1)) if column is None else F.sum(column)

    def earlier(groups: list[str], by: list[str], column: str | None) -> Column:
        window = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(*by)
        if column is None:
            return F.row_number().over(window).cast("long") - 1
        frame = window.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(column).over(frame), F.lit(0))

    if not splits:
        return df.withColumn(out, earlier(keys, [order, *ties], weight))
    ranged = df.withColumn("__range", range_of(F.col(order), splits))
    body = ranged.withColumn("__inside", earlier([*keys, "__range"], [order, *ties], weight))
    totals = ranged.groupBy(*keys, "__range").agg(total(weight).alias("__total"))
    offsets = totals.select(*keys, "__range", earlier(keys, ["__range"], "__total").alias("__offset"))
    summed = body.join(offsets, [*keys, "__range"]).withColumn("__sum", F.col("__inside") + F.col("__offset"))
    return summed.drop("__inside", "__offset", "__range", out).withColumnRenamed("__sum", out)


def number_rows(source: DataFrame | Sized, order: str, out: str, *, rows_per_range: int | None = None) -> DataFrame:
    """Zero-based position of each row in a total, unique order, without one task sorting everything."""
    sized = source if isinstance(source, Sized) else settle(source)
    return cumulate(sized.df, order, out, splits=order_splits(sized, order, rows_per_range))
