"""Image histograms and percentiles."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.numeric import finite_or_null
from tesserae.scale import cumulate, order_splits, settle

DEFAULT_BINS = 256


def exclude_values(df: DataFrame, value: str = "value", *, nan: bool = True, zeros: bool = False) -> DataFrame:
    """Drop NaN (and missing) values, and zeros, as asked."""
    if nan:
        df = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if zeros:
        df = df.where(F.col(value) != 0)
    return df


def check_range(value_range: tuple[float, float] | None) -> tuple[float, float] | None:
    if value_range is None:
        return None
    low, high = map(float, value_range)
    if not (math.isfinite(low) and math.isfinite(high)) or low >= high:
        raise ValueError("A value range needs finite bounds with low < high.")
    return low, high


def data_range(df: DataFrame, value: str = "value") -> Column:
    """Scalar subquery `(lo, hi)` of the values; constant data widens to one unit; no finite value stops the job."""
    low, high = F.min(finite_or_null(F.col(value))), F.max(finite_or_null(F.col(value)))
    ends = df.agg(low.alias("lo"), high.alias("hi")).select(
        F.struct(
            F.coalesce("lo", F.raise_error(F.lit("A histogram needs at least one finite value.")).cast("double")).alias("lo"),
            F.when(F.col("lo") == F.col("hi"), F.col("lo") + 1.0).otherwise(F.col("hi")).alias("hi"),
        )
    )
    return ends.scalar()


def bin_edge(index: Column, low: Column, high: Column, bins: int) -> Column:
    return F.when(index == bins, high).otherwise(low + index * ((high - low) / bins))


def bin_index(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Zero-based bin, null outside the range; the last bin is closed.

    The scaled position can be one off next to an edge, so it is compared with the edges themselves.
    """
    guess = F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1))
    below = value < bin_edge(guess, low, high, bins)
    above = (value >= bin_edge(guess + 1, low, high, bins)) & (guess != bins - 1)
    index = F.when(below, guess - 1).when(above, guess + 1).otherwise(guess)
    return F.when((value >= low) & (value <= high), index)


def histogram(
    df: DataFrame, value: str = "value", *, bins: int = DEFAULT_BINS,
    value_range: tuple[float, float] | None = None, density: bool = False,
) -> DataFrame:
    """`bin, lo, hi, count` for equal bins, empty bins included; `density` divides by total and width."""
    if isinstance(bins, bool) or not isinstance(bins, int) or bins <= 0:
        raise ValueError("The number of bins must be a positive integer.")
    fixed = check_range(value_range)
    ends = F.struct(F.lit(fixed[0]).alias("lo"), F.lit(fixed[1]).alias("hi")) if fixed else data_range(df, value)
    low, high = F.col("__ends.lo"), F.col("__ends.hi")
    counts = (
        df.select(F.col(value).cast("double").alias("v"), ends.alias("__ends"))
        .select(bin_index(F.col("v"), low, high, bins).alias("bin"))
        .where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    )
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"), ends.alias("__ends"))
    filled = every.join(F.broadcast(counts), "bin", "left").select(
        "bin", bin_edge(F.col("bin"), low, high, bins).alias("lo"), bin_edge(F.col("bin") + 1, low, high, bins).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("count"),
    )
    if not density:
        return filled
    total = counts.agg(F.sum("n")).scalar()
    return filled.withColumn("count", F.col("count") / total / (F.col("hi") - F.col("lo")))


def check_percentiles(wanted: Sequence[float]) -> list[float]:
    kept: list[float] = []
    for q in map(float, wanted):
        if not math.isfinite(q) or not 0 <= q <= 100:
            raise ValueError("Percentiles must be finite numbers from 0 to 100.")
        if q not in kept:
            kept.append(q)
    return kept


def percentiles(df: DataFrame, wanted: Sequence[float], value: str = "value") -> DataFrame:
    """Exact percentiles with linear interpolation as `(q, value)`.

    Equal values are counted first; the counts are then summed in value order over ranges, so no task holds all
    distinct values (the built-in exact percentile keeps them in one aggregate buffer).
    """
    wanted = check_percentiles(wanted)
    counts = settle(df.groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")).where("v is not null"))
    placed = cumulate(counts.df, "v", "before", weight="n", splits=order_splits(counts, "v"))
    total = counts.df.agg(F.sum("n").alias("total")).scalar()

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col("v")))

    ranks = [(total - 1) * F.lit(q / 100.0) for q in wanted]
    picked = placed.agg(
        *[at(F.floor(r)).alias(f"lo{i}") for i, r in enumerate(ranks)],
        *[at(F.ceil(r)).alias(f"hi{i}") for i, r in enumerate(ranks)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(q).alias("q"),
                (F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (r - F.floor(r))).alias("value"),
            )
            for i, (q, r) in enumerate(zip(wanted, ranks))
        ]
    )
    return picked.select(F.inline(rows))


def approximate_percentiles(df: DataFrame, wanted: Sequence[float], value: str = "value", accuracy: int = 10_000) -> DataFrame:
    """The same from a bounded sketch: one pass, one small buffer per task."""
    wanted = check_percentiles(wanted)
    sketch = df.agg(F.percentile_approx(value, [q / 100.0 for q in wanted], accuracy).alias("values"))
    pairs = F.arrays_zip(F.lit(wanted).alias("q"), F.col("values").alias("value"))
    return sketch.select(F.inline(pairs)).toDF("q", "value")


SKETCH_SIZE = 4_096
# share of the rows by which a percentile of a sketch of `SKETCH_SIZE` may be misplaced, with 99 % confidence: 2.3 / size ** 0.9
RANK_ERROR = 0.0014


def percentile_sketches(df: DataFrame, *keys: str, value: str = "value", size: int = SKETCH_SIZE) -> DataFrame:
    """`(keys, sketch)`: a quantile sketch of the values of each key, from one pass; missing values and NaN are left out.

    A sketch takes some ten thousand bytes however many values it has seen, can be stored, and merged with others.
    """
    number = F.col(value).cast("double")
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(F.when(~F.isnan(number), number), size).alias("sketch"))


def merged_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches of coarser keys, such as of all images of a channel, from stored ones; no value is read again."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_percentiles(sketches: DataFrame, wanted: Sequence[float], *keys: str) -> DataFrame:
    """`(keys, q, value)` from sketches, off in rank by `RANK_ERROR` or so. A sketch without values gives null."""
    values = [
        F.struct(F.lit(q).alias("q"), F.when(F.kll_sketch_get_n_double("sketch") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q / 100.0))).alias("value"))
        for q in check_percentiles(wanted)
    ]
    return sketches.select(*keys, F.inline(F.array(*values)))
