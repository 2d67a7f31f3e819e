"""A nested pyramid of point samples: bounded tiles for overviews, fair to space and to rare values.

Sampled level k has tiles of `leaf * 2**k` with at most `capacity * 2**k` points. Level 0 samples the exact level; each further
level samples the one below, so a point of a level is on all finer ones. All quotas follow from counts, level by level:

* a tile's quota is shared among its strata (a small grid of cells on level 0, the four child tiles above), and a stratum's
  quota among its values, in proportion to the square root of the counts; rare values weigh up to four times as much;
* each gets one point first, if there are enough; nobody gets more than there is, and what is over goes to the others;
* fractions go to the largest remainders. All of it is integer arithmetic, so the order of rows and partitions has no effect.

Within a stratum and value, the points with the smallest digests stay. On level 0 a digest bound from the counts leaves few
more points than are wanted before any are ordered; ranks are taken in ranges of the digest, so no tile is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.tiles import TileGrid, tile_index
from tesserae.scale import Sized, cumulate, join_sized, order_splits, settle

CAPACITY = 4_096
CELLS = 8
FAIRNESS = 1_024
MAX_BOOST = 4
DIGEST_BITS = 60
GROUP = ["px", "py", "cell", "value"]
PLACE = [f"__{c}" for c in GROUP]


def priority(value: Column, point_id: Column, seed: int) -> Column:
    """60 bits of the MD5 digest of seed, value and id: the order in which points stay."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), value.cast("string"), point_id.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGEST_BITS // 4), 16, 10).cast("long")


def weight(count: Column) -> Column:
    """The share of a count, concave: its square root in steps of 1/1024."""
    return F.floor(F.sqrt(count.cast("double")) * FAIRNESS)


def _wide(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(19,0)")


def apportion(df: DataFrame, keys: list[str], item: str, count: str, weights: str, target: str, out: str) -> DataFrame:
    """Add `out`: how many of its `count` each item gets of the `target` of its group.

    Items get in proportion to `weights`, but no more than their count (what exceeds it is shared by the rest), and one at least
    if the target suffices for that. Remainders go to the largest fractions, then to the smallest item. The target
    must not exceed the sum of the counts. Products are taken in decimals of 38 digits.
    """
    group = Window.partitionBy(*keys)
    each = F.when(F.col(target) >= F.count(F.lit(1)).over(group), F.lit(1)).otherwise(F.lit(0))
    rows = df.withColumn("__each", each.cast("long")).withColumn("__room", F.col(count) - F.col("__each"))
    rows = rows.withColumns({
        "__rest": F.col(target) - F.sum("__each").over(group), "__ratio": F.col("__room") / F.col(weights),
    })
    before = group.orderBy("__ratio", item).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("__room").over(before), F.lit(0))
    heavier = F.sum(weights).over(group) - F.coalesce(F.sum(weights).over(before), F.lit(0))
    rows = rows.withColumn("__full", _wide("__room") * _wide(heavier) <= _wide(F.col("__rest") - earlier) * _wide(weights))
    rows = rows.withColumns({
        "__rest": F.col("__rest") - F.sum(F.when(F.col("__full"), F.col("__room")).otherwise(0)).over(group),
        "__open": F.nullif(F.sum(F.when(F.col("__full"), 0).otherwise(F.col(weights))).over(group), F.lit(0)),
    })
    rows = rows.withColumns({"__product": _wide("__rest") * _wide(weights), "__open": _wide("__open")})
    rows = rows.withColumns({
        "__floor": F.when(F.col("__full"), F.col("__room")).otherwise(F.expr("__product DIV __open")),
        "__part": F.when(~F.col("__full"), F.expr("__product % __open")),
    })
    over = F.col("__rest") - F.sum(F.when(F.col("__full"), 0).otherwise(F.col("__floor"))).over(group)
    turn = F.row_number().over(group.orderBy(F.desc_nulls_last("__part"), item))
    extra = F.when(~F.col("__full") & (turn <= over), 1).otherwise(0)
    rows = rows.withColumn(out, F.least(F.col(count), F.col("__each") + F.col("__floor") + extra).cast("long"))
    return rows.drop("__each", "__room", "__rest", "__ratio", "__full", "__open", "__product", "__floor", "__part")


def value_boosts(counts: DataFrame, max_boost: int = MAX_BOOST) -> Sized:
    """`(value, boost)`: 1 for usual values, up to `max_boost` for those far below the mean count."""
    totals = counts.groupBy("value").agg(F.sum("n").alias("n"))
    mean = totals.agg((F.sum("n") / F.count(F.lit(1))).alias("mean")).scalar()
    boost = F.floor(F.sqrt(mean / F.col("n")))
    return settle(totals.select("value", F.least(F.lit(max_boost), F.greatest(F.lit(1), boost)).cast("long").alias("boost")))


def level_quotas(counts: DataFrame, boosts: Sized, capacity: int) -> Sized:
    """`(px, py, cell, value, n, quota)` of one level from `counts(px, py, cell, value, n)` of what may be kept."""
    strata = counts.groupBy("px", "py", "cell").agg(F.sum("n").alias("stratum"))
    strata = strata.withColumn("goal", F.least(F.lit(capacity).cast("long"), F.sum("stratum").over(Window.partitionBy("px", "py"))))
    strata = apportion(strata.withColumn("w", weight(F.col("stratum"))), ["px", "py"], "cell", "stratum", "w", "goal", "target")
    rows = join_sized(counts, boosts, "value").withColumn("w", weight(F.col("n")) * F.col("boost"))
    rows = rows.join(strata.select("px", "py", "cell", "target"), ["px", "py", "cell"])
    return settle(apportion(rows, ["px", "py", "cell"], "value", "n", "w", "target", "quota").select(*GROUP, "n", "quota"))


def pyramid_quotas(counts: DataFrame, levels: int, capacity: int = CAPACITY) -> list[Sized]:
    """The quotas of all levels, each from the one below; no point is read."""
    first = settle(counts)
    boosts = value_boosts(first.df)
    quotas = [level_quotas(first.df, boosts, capacity)]
    for level in range(1, levels):
        kept = quotas[-1].df.where("quota > 0").groupBy("px", "py", "value").agg(F.sum("quota").alias("n"))
        above = kept.select(
            F.shiftright("px", 1).alias("px"), F.shiftright("py", 1).alias("py"),
            (F.col("py").bitwiseAND(F.lit(1)) * 2 + F.col("px").bitwiseAND(F.lit(1))).alias("cell"), "value", "n",
        )
        quotas.append(level_quotas(above, boosts, capacity << level))
    return quotas


def _ranked(sized: Sized, keys: list[str], point_id: str) -> DataFrame:
    """Add `__rank`, the number of points of the same keys that come before. The points are read twice, so they are settled ones."""
    return cumulate(sized.df, "__priority", "__rank", keys=keys, splits=order_splits(sized, "__priority"), ties=[point_id])


def _renamed(quotas: Sized) -> Sized:
    """Quotas under names that don't meet those of the points."""
    return Sized(quotas.df.select(*[F.col(c).alias(f"__{c}") for c in quotas.df.columns]), quotas.rows, quotas.nbytes)


def _first_level(placed: DataFrame, quotas: Sized, point_id: str) -> DataFrame:
    """The points with the smallest digests of each group. The digest bound leaves a margin of eight standard deviations; a
    group that still falls short of its quota is taken again without the bound, so the result doesn't depend on it."""
    every = float(1 << DIGEST_BITS)
    wanted = F.col("__quota") + 8 * F.sqrt(F.col("__quota").cast("double")) + 32
    bound = F.when(wanted < F.col("__n"), wanted / F.col("__n") * F.lit(every)).otherwise(F.lit(every))
    bounded = Sized(quotas.df.where("__quota > 0").withColumn("__bound", bound), quotas.rows, quotas.nbytes)
    joined = join_sized(placed, bounded, PLACE, counts=quotas.df.select(*PLACE, "__n"))
    near = settle(joined.where(F.col("__priority") < F.col("__bound")).drop("__bound", "__n"))
    found = near.df.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("__found"))
    short = bounded.df.join(found, PLACE, "left").where(F.coalesce("__found", F.lit(0)) < F.col("__quota"))
    short = settle(short.select(*PLACE, "__quota"))
    if short.rows:
        again = join_sized(placed, short, PLACE).select(*near.df.columns)
        near = settle(near.df.join(short.df.drop("__quota"), PLACE, "left_anti").unionByName(again))
    return _ranked(near, PLACE, point_id).where(F.col("__rank") < F.col("__quota")).drop("__rank", "__quota")


def coarse_levels(
    points: DataFrame, grid: TileGrid, point_id: str, value: str, x: str = "x", y: str = "y", *,
    capacity: int = CAPACITY, cells: int = CELLS, seed: int = 0,
) -> DataFrame:
    """Points on any sampled level, with `tile_x, tile_y` (of the leaf tiles) and `coarsest`, the last level that has them.

    Level k consists of the rows with `coarsest >= k`; there are as many sampled levels as the grid has sizes. `point_id` must be
    unique, `value` must not be null, coordinates must be finite. `cells`, a power of two, is the side of level 0's strata grid.
    """
    if cells < 1 or cells & (cells - 1):
        raise ValueError("The number of cells must be a power of two.")
    if capacity < 1:
        raise ValueError("The capacity must be positive.")
    shift = cells.bit_length() - 1
    fine = {c: tile_index(F.col(p), o, grid.leaf / cells) for c, p, o in (("__fx", x, grid.x_origin), ("__fy", y, grid.y_origin))}
    inside = F.col("__fy").bitwiseAND(F.lit(cells - 1)) * cells + F.col("__fx").bitwiseAND(F.lit(cells - 1))
    placed = points.withColumns(fine).withColumns({
        "__px": F.shiftright("__fx", shift), "__py": F.shiftright("__fy", shift), "__cell": inside, "__value": F.col(value),
    }).drop("__fx", "__fy")
    counts = placed.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n")).withColumnsRenamed({p: g for p, g in zip(PLACE, GROUP)})
    quotas = pyramid_quotas(counts, grid.n_levels, capacity)
    kept = _first_level(placed.withColumn("__priority", priority(F.col(value), F.col(point_id), seed)), _renamed(quotas[0]), point_id)
    kept = settle(kept.withColumns({"tile_x": F.col("__px"), "tile_y": F.col("__py")}).drop("__cell"))
    dropped = []
    for level in range(1, grid.n_levels):
        # __px, __py of a point: its tile on the level below, which is a stratum of this one
        shares = _renamed(quotas[level])
        child = {"__px": F.col("__px") * 2 + F.col("__cell").bitwiseAND(F.lit(1)), "__py": F.col("__py") * 2 + F.shiftright("__cell", 1)}
        shares = Sized(shares.df.withColumns(child).drop("__cell", "__n"), shares.rows, shares.nbytes)
        keys = ["__px", "__py", "__value"]
        joined = join_sized(_ranked(kept, keys, point_id), shares, keys)
        judged = settle(joined.withColumn("__stays", F.col("__rank") < F.col("__quota")).drop("__rank", "__quota"))
        dropped.append(judged.df.where("NOT __stays").withColumn("coarsest", F.lit(level - 1)))
        stay = judged.df.where("__stays").withColumns({"__px": F.shiftright("__px", 1), "__py": F.shiftright("__py", 1)}).drop("__stays")
        kept = Sized(stay, judged.rows, judged.nbytes)
    rows = kept.df.withColumn("coarsest", F.lit(grid.n_levels - 1))
    columns = [*points.columns, "tile_x", "tile_y", "coarsest"]
    rows = rows.select(*columns)
    for part in dropped:
        rows = rows.unionAll(part.select(*columns))
    return rows


def level_points(coarse: DataFrame, level: int) -> DataFrame:
    """The points of one sampled level, with its tiles."""
    kept = coarse.where(F.col("coarsest") >= level)
    return kept.withColumns({"tile_x": F.shiftright("tile_x", level), "tile_y": F.shiftright("tile_y", level)})
