"""Per-object features from pixel tables `(region, label, y, x[, channel, value])`."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.sources.raster import INTEGER_LIMITS

INTENSITY_FEATURES = ("sum", "mean", "var", "min", "max", "kurtosis", "skew")

# Neighbour weights and lengths of the usual 4-connected perimeter estimate. A border pixel weighs 1
# itself, 2 per border neighbour along an axis and 10 per diagonal one; the sum decides the length it adds.
AXIS_WEIGHT, DIAGONAL_WEIGHT = 2, 10
PERIMETER_LENGTHS = (
    ((5, 7, 15, 17, 25, 27), 1.0),
    ((21, 33), math.sqrt(2)),
    ((13, 23), (1 + math.sqrt(2)) / 2),
)

# Fixed value: variance of a unit square along an axis, added because a pixel is an area.
PIXEL_VARIANCE = 1.0 / 12.0


def centers(pixels: DataFrame) -> DataFrame:
    """Mean pixel index per object; integer indices are pixel centers and z is zero for a plane."""
    return pixels.groupBy("region", "label").agg(
        F.lit(0.0).alias("cz"), F.avg(F.col("y").cast("double")).alias("cy"), F.avg(F.col("x").cast("double")).alias("cx")
    )


def canonical_centers(pixels: DataFrame, requested: DataFrame) -> DataFrame:
    """Centers of the requested `(region, instance_id)`, null where the raster does not hold the object.

    A mean is partially aggregated before the shuffle, so a huge object costs no more than a small one.
    """
    found = centers(pixels).withColumnRenamed("label", "instance_id")
    return requested.select("region", "instance_id").join(found, ["region", "instance_id"], "left")


def missing_centers(with_centers: DataFrame) -> DataFrame:
    return with_centers.where(F.col("cy").isNull() | F.col("cx").isNull()).select("region", "instance_id")


def ids_beyond_dtype(requested: DataFrame, dtype: str) -> DataFrame:
    """Requested ids that the labels raster cannot represent."""
    return requested.where(F.col("instance_id") > F.lit(INTEGER_LIMITS[dtype]))


def intensity_features(
    pixels: DataFrame, channels: Sequence[str], features: Sequence[str] = INTENSITY_FEATURES
) -> DataFrame:
    """Columns `feature__channel`, channels in request order. One aggregation, variance and moments of the population,
    kurtosis in excess of the normal distribution."""
    unknown = [f for f in features if f not in INTENSITY_FEATURES]
    if unknown:
        raise ValueError(f"Unknown intensity feature(s): {unknown}.")
    if len(set(channels)) != len(channels):
        raise ValueError("Channels must not repeat.")
    makers = {
        "sum": F.sum, "mean": F.avg, "var": F.var_pop, "min": F.min, "max": F.max,
        "kurtosis": F.kurtosis, "skew": F.skewness,
    }
    columns = [
        makers[f](F.when(F.col("channel") == channel, F.col("value").cast("double"))).alias(f"{f}__{channel}")
        for f in features
        for channel in channels
    ]
    return pixels.groupBy("region", "label").agg(*columns)


# Shapes as bitmaps -----------------------------------------------------------------------------------------------
#
# A word holds 64 neighbouring pixels of one line of one object, a bit for each. Neighbours of all 64 are found by shifts, with the
# bits that come in from the words beside, and what lies around them is added bit by bit in parallel.


def pixel_words(pixels: DataFrame) -> DataFrame:
    """`(region, label, y, xw, b)`: the pixels `x` from 64 xw on, bit by bit. A pixel that is repeated counts once. Words at the end
    of which a pixel lies have a neighbour word, an empty one if need be."""
    x = F.col("x").cast("long")
    bit = F.expr("shiftleft(1L, CAST(CAST(x AS BIGINT) & 63 AS INT))")

    def word(step: int, bits: Column) -> Column:
        return F.struct((F.shiftright(x, 6) + step).alias("xw"), bits.alias("b"))

    own, none, at = word(0, bit), F.lit(0).cast("long"), x.bitwiseAND(F.lit(63))
    sent = F.when(at == 0, F.array(own, word(-1, none))).when(at == 63, F.array(own, word(1, none))).otherwise(F.array(own))
    return pixels.select("region", "label", F.col("y").cast("long").alias("y"), F.inline(sent)).groupBy("region", "label", "y", "xw").agg(
        F.bit_or("b").alias("b"))


def _next_to(columns: Sequence[str], window, axis: str, names: tuple[str, str]) -> dict[str, Column]:
    """The words before and after, empty where there is none: `<name>_<column>`."""
    found = {}
    for name, move, step in ((names[0], F.lag, -1), (names[1], F.lead, 1)):
        there = move(axis).over(window) == F.col(axis) + step
        found |= {f"{name}_{c}": F.when(there, move(c).over(window)).otherwise(F.lit(0).cast("long")) for c in columns}
    return found


def _before(word: str, left: str) -> Column:
    """Each bit's neighbour towards smaller x."""
    return F.shiftleft(F.col(word), 1).bitwiseOR(F.shiftrightunsigned(F.col(left), 63))


def _after(word: str, right: str) -> Column:
    return F.shiftrightunsigned(F.col(word), 1).bitwiseOR(F.shiftleft(F.col(right), 63))


def _all(*words: Column) -> Column:
    return reduce(lambda a, b: a.bitwiseAND(b), words)


def _any(*words: Column) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), words)


def _number(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column, Column]:
    """How many of four words have a bit, as the three digits of a binary number."""
    ab, cd, both = a.bitwiseXOR(b), c.bitwiseXOR(d), [a.bitwiseAND(b), c.bitwiseAND(d)]
    carry = ab.bitwiseAND(cd)
    return ab.bitwiseXOR(cd), reduce(lambda p, q: p.bitwiseXOR(q), [*both, carry]), _any(_all(*both), _all(both[0], carry), _all(both[1], carry))


def border_words(words: DataFrame) -> DataFrame:
    """Add `border`, the pixels that lack one of their four neighbours in the object, and of the lines around it and of the words
    beside the same. Words of a line meet, then words of a column, then those of a line again."""
    along_x = Window.partitionBy("region", "label", "y").orderBy("xw")
    along_y = Window.partitionBy("region", "label", "xw").orderBy("y")
    rows = words.withColumns(_next_to(["b"], along_x, "xw", ("left", "right")))
    rows = rows.withColumns(_next_to(["b"], along_y, "y", ("above", "below")))
    inner = _all(_before("b", "left_b"), _after("b", "right_b"), F.col("above_b"), F.col("below_b"))
    rows = rows.select("region", "label", "y", "xw", "b", F.col("b").bitwiseAND(F.bitwise_not(inner)).alias("border"))
    rows = rows.withColumns(_next_to(["border"], along_y, "y", ("above", "below")))
    return rows.withColumns(_next_to(["border", "above_border", "below_border"], along_x, "xw", ("left", "right")))


def _perimeter_counts(rows: DataFrame) -> DataFrame:
    """Add `p0`, `p1`, `p2`: border pixels that add each length of the estimate."""
    lines = ("border", "above_border", "below_border")
    before = {c: _before(c, f"left_{c}") for c in lines}
    after = {c: _after(c, f"right_{c}") for c in lines}
    axis = _number(F.col("above_border"), F.col("below_border"), before["border"], after["border"])
    diagonal = _number(*(side[c] for side in (before, after) for c in lines[1:]))
    rows = rows.withColumns({f"__{n}{i}": digit for n, digits in (("a", axis), ("d", diagonal)) for i, digit in enumerate(digits)})

    def equal(name: str, number: int) -> Column:
        return _all(*(F.col(f"__{name}{i}") if number >> i & 1 else F.bitwise_not(F.col(f"__{name}{i}")) for i in range(3)))

    counts = {}
    for k, (sums, _) in enumerate(PERIMETER_LENGTHS):
        kinds = [(a, d) for a in range(5) for d in range(5) if 1 + AXIS_WEIGHT * a + DIAGONAL_WEIGHT * d in sums]
        counts[f"p{k}"] = F.bit_count(F.col("border").bitwiseAND(_any(*(_all(equal("a", a), equal("d", d)) for a, d in kinds))))
    return rows.withColumns(counts)


def _place_sums(word: str) -> tuple[Column, Column]:
    """Sum of the places of a word's bits, and of their squares."""
    masks = [sum(1 << i for i in range(64) if i >> k & 1) for k in range(6)]
    masks = [F.lit(m - (1 << 64) if m >> 63 else m) for m in masks]
    count = lambda *chosen: F.bit_count(_all(F.col(word), *chosen)).cast("long")
    first = sum((count(masks[k]) * (1 << k) for k in range(1, 6)), count(masks[0]))
    square = sum((count(masks[j], masks[k]) * (1 << j + k) for j in range(6) for k in range(6) if j or k), count(masks[0]))
    return first, square


def _ends(word: str) -> tuple[Column, Column]:
    """Places of the lowest and the highest bit."""
    up = down = F.col(word)
    for k in range(6):
        up, down = up.bitwiseOR(F.shiftleft(up, 1 << k)), down.bitwiseOR(F.shiftrightunsigned(down, 1 << k))
    return F.lit(64) - F.bit_count(up), F.bit_count(down) - 1


# Hulls -----------------------------------------------------------------------------------------------------------


def _chain(lines: Column, sign: int) -> Column:
    """Convex chain of `u = sign x` over y along one side of an object, from the half-pixel diamonds of its line ends."""
    def corners(line: Column) -> Column:
        u = (line["low"] if sign > 0 else -line["high"]).cast("double")
        y = line["y"].cast("double")
        return F.array(*(F.struct((y + dy).alias("y"), (u - du).alias("u")) for dy, du in ((-0.5, 0.0), (0.0, 0.5), (0.5, 0.0))))

    def add(kept: Column, p: Column) -> Column:
        def turns(b: Column, i: Column) -> Column:
            a = F.get(kept, i - 1)
            return (i == 0) | ((b["y"] - a["y"]) * (p["u"] - a["u"]) > (b["u"] - a["u"]) * (p["y"] - a["y"]))

        # the chain is convex, so those that turn the right way come first
        return F.when(F.get(kept, F.size(kept) - 1)["y"] == p["y"], kept).otherwise(F.concat(F.filter(kept, turns), F.array(p)))

    points = F.array_sort(F.flatten(F.transform(lines, corners)))
    return F.aggregate(points, F.array().cast("array<struct<y:double,u:double>>"), add)


def _reach(lines: Column, sign: int) -> Column:
    """The first whole `u` in the hull, for each line from the first to the last of the object."""
    def step(state: Column, q: Column) -> Column:
        p = state["p"]
        rows = F.sequence(F.ceil(p["y"]), F.ceil(q["y"]) - 1)
        at = lambda y: F.ceil(p["u"] + (q["u"] - p["u"]) * ((y - p["y"]) / (q["y"] - p["y"])) - 1e-9)
        more = F.when(F.ceil(p["y"]) < F.ceil(q["y"]), F.transform(rows, at)).otherwise(F.array().cast("array<bigint>"))
        return F.struct(q.alias("p"), F.concat(state["found"], F.coalesce(more, F.array().cast("array<bigint>"))).alias("found"))

    start = F.struct(F.lit(None).cast("struct<y:double,u:double>").alias("p"), F.array().cast("array<bigint>").alias("found"))
    return F.aggregate(_chain(lines, sign), start, step, lambda state: state["found"])


def hull_of_lines(lines: Column) -> Column:
    """`(n, sy, sx)` of the convex hull of an object given by its lines `(y, low, high)`: pixels, and sums of their coordinates
    relative to the first line and to zero."""
    spans = F.zip_with(_reach(lines, 1), _reach(lines, -1), lambda a, b: F.struct(a.alias("a"), (-b).alias("b")))

    def add(state: Column, span: Column) -> Column:
        n = F.greatest(span["b"] - span["a"] + 1, F.lit(0)).cast("double")
        return F.struct(
            (state["i"] + 1).alias("i"), (state["n"] + n).alias("n"), (state["sy"] + n * state["i"]).alias("sy"),
            (state["sx"] + n * (span["a"] + span["b"]).cast("double") / 2).alias("sx"))

    zero = F.lit(0.0)
    return F.aggregate(spans, F.struct(zero.alias("i"), zero.alias("n"), zero.alias("sy"), zero.alias("sx")), add)


def morphology_features(pixels: DataFrame, *, hull: bool = True, pixel_variance: float = PIXEL_VARIANCE) -> DataFrame:
    """All shape features per object. Pixel rows that repeat (such as one per channel) count once.

    Pixels become words before the first shuffle; three shuffles of words and a small one of objects follow. For the hull an
    object gathers the two ends of each of its lines, which the height of the raster bounds. Coordinates may have 28 bits.
    """
    rows = _perimeter_counts(border_words(pixel_words(pixels)))
    first, square = _place_sums("b")
    low, high = _ends("b")
    start = F.col("xw") * 64
    n = F.bit_count("b").cast("long")
    rows = rows.where("b <> 0").select(
        "region", "label", "y", n.alias("n"), "p0", "p1", "p2", (n * start + first).alias("sx"), (n * start * start + 2 * start * first + square).alias("sxx"),
        (start + low).alias("low"), (start + high).alias("high"),
    )
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    lines = rows.groupBy("region", "label", "y").agg(
        *(F.sum(c).alias(c) for c in ("n", "p0", "p1", "p2", "sx")), F.sum(wide("sxx")).alias("sxx"), F.min("low").alias("low"), F.max("high").alias("high"))
    y = wide("y")
    facts = [
        *(F.sum(c).alias(c) for c in ("n", "p0", "p1", "p2")), F.sum(wide("sx")).alias("sx"), F.sum("sxx").alias("sxx"), F.sum(y * wide("n")).alias("sy"),
        F.sum(y * y.cast("decimal(9,0)") * F.col("n").cast("decimal(9,0)")).alias("syy"), F.sum(y * wide("sx").cast("decimal(18,0)")).alias("sxy"),
    ]
    if hull:
        facts.append(F.sort_array(F.collect_list(F.struct("y", "low", "high"))).alias("lines"))
    base = lines.groupBy("region", "label").agg(*facts)
    base = base.withColumns({"mx": F.expr("sx DIV n"), "my": F.expr("sy DIV n")})
    d = lambda text: F.expr(f"CAST({text} AS DOUBLE)")
    # about whole numbers near the means, so that nothing is lost when large sums are subtracted
    base = base.withColumns({
        "rx": d("sx - mx * n") / F.col("n"), "ry": d("sy - my * n") / F.col("n"),
        "vxx": d("sxx - 2 * mx * sx + CAST(mx AS DECIMAL(20, 0)) * mx * n") / F.col("n"),
        "vyy": d("syy - 2 * my * sy + CAST(my AS DECIMAL(20, 0)) * my * n") / F.col("n"),
        "vxy": d("sxy - mx * sy - my * sx + CAST(mx AS DECIMAL(20, 0)) * my * n") / F.col("n"),
    })
    base = base.withColumns({
        "area": F.col("n").cast("double"), "cy": F.col("my") + F.col("ry"), "cx": F.col("mx") + F.col("rx"),
        "vy": F.col("vyy") - F.col("ry") * F.col("ry") + pixel_variance, "vx": F.col("vxx") - F.col("rx") * F.col("rx") + pixel_variance,
        "c": F.col("vxy") - F.col("rx") * F.col("ry"),
        "perimeter": sum((F.col(f"p{k}") * F.lit(length) for k, (_, length) in enumerate(PERIMETER_LENGTHS)), F.lit(0.0)),
    })
    kept = ["region", "label", "area", "cy", "cx", "vy", "vx", "c", "perimeter", *(["lines"] if hull else [])]
    base = base.select(*kept)
    middle = (F.col("vy") + F.col("vx")) / 2
    spread = F.sqrt(F.pow((F.col("vy") - F.col("vx")) / 2, F.lit(2)) + F.col("c") * F.col("c"))
    axes = base.withColumns({"l1": middle + spread, "l2": F.greatest(middle - spread, F.lit(0.0))})
    shaped = axes.withColumns(
        {
            "eccentricity": F.sqrt(F.greatest(1 - F.col("l2") / F.nullif(F.col("l1"), F.lit(0.0)), F.lit(0.0))),
            "major_axis_length": 4 * F.sqrt("l1"),
            "minor_axis_length": 4 * F.sqrt("l2"),
            "equivalent_diameter": F.sqrt(4 * F.col("area") / math.pi),
            "perim_square_over_area": F.col("perimeter") * F.col("perimeter") / F.col("area"),
        }
    ).withColumns(
        {
            "major_minor_axis_ratio": F.col("major_axis_length") / F.nullif(F.col("minor_axis_length"), F.lit(0.0)),
            "major_axis_equiv_diam_ratio": F.col("major_axis_length") / F.col("equivalent_diameter"),
        }
    ).drop("vy", "vx", "c", "l1", "l2")
    if not hull:
        return shaped.drop("cy", "cx")
    hulled = shaped.withColumn("h", hull_of_lines(F.col("lines"))).withColumns({
        "convex_area": F.col("h.n"), "hull_cy": F.get("lines", F.lit(0))["y"] + F.col("h.sy") / F.col("h.n"), "hull_cx": F.col("h.sx") / F.col("h.n"),
    }).drop("lines", "h")
    shift = F.sqrt(F.pow(F.col("cy") - F.col("hull_cy"), F.lit(2)) + F.pow(F.col("cx") - F.col("hull_cx"), F.lit(2)))
    return hulled.withColumns(
        {
            "convex_hull_resid": (F.col("convex_area") - F.col("area")) / F.col("convex_area"),
            "centroid_dif": shift / F.sqrt("area"),
        }
    ).drop("hull_cy", "hull_cx", "cy", "cx")
