import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae import scale
from tesserae.operators import histogram as H
from tesserae.operators import pixels as X
from tesserae.sources import raster as R


def values(spark, numbers):
    return spark.createDataFrame([(v,) for v in numbers], "value double")


RNG = np.random.default_rng(3)


@pytest.mark.parametrize(
    "numbers, bins, value_range",
    [
        (RNG.random(500).tolist(), 8, None),
        (RNG.random(500).tolist(), 8, (0.25, 0.75)),
        ((np.arange(100) / 10).tolist(), 10, None),
        ((np.arange(0, 31) / 10).tolist(), 30, (0.0, 3.0)),
        ([0.1 * i for i in range(64)], 63, None),
        ([5.0] * 7, 4, None),
        ([-3.0, 0.0, 3.0], 2, None),
    ],
)
@pytest.mark.parametrize("density", [False, True])
def test_histogram_matches_numpy(spark, numbers, bins, value_range, density):
    span = value_range or (min(numbers), max(numbers) if max(numbers) > min(numbers) else max(numbers) + 1)
    want, edges = np.histogram(numbers, bins=bins, range=span, density=density)
    rows = H.histogram(values(spark, numbers), bins=bins, value_range=value_range, density=density).orderBy("bin").collect()
    assert np.allclose([r["count"] for r in rows], want)
    assert np.allclose([r.lo for r in rows], edges[:-1]) and np.allclose([r.hi for r in rows], edges[1:])


def test_histogram_skips_what_is_excluded(spark):
    df = values(spark, [0.0, 1.0, 2.0, float("nan"), None])
    kept = H.exclude_values(df, zeros=True)
    assert sorted(r.value for r in kept.collect()) == [1.0, 2.0]
    assert H.exclude_values(df, nan=False).count() == 5
    assert H.histogram(df, bins=2).agg(F.sum("count")).first()[0] == 3


def test_histogram_needs_a_finite_value(spark):
    with pytest.raises(Exception, match="finite"):
        H.histogram(values(spark, [float("nan"), float("inf")]), bins=2).collect()


@pytest.mark.parametrize("options", [{"bins": 0}, {"bins": True}, {"bins": 2, "value_range": (1, 1)}, {"bins": 2, "value_range": (0, math.inf)}])
def test_histogram_settings(spark, options):
    with pytest.raises(ValueError):
        H.histogram(values(spark, [1.0]), **options)


@pytest.mark.parametrize("rows_per_range", [10**6, 15])
def test_percentiles_match_numpy(spark, monkeypatch, rows_per_range):
    monkeypatch.setattr(scale, "ROWS_PER_RANGE", rows_per_range)
    numbers = [round(float(v), 2) for v in RNG.normal(size=400)] + [0.5] * 300
    wanted = [0, 1, 25, 50, 75, 99.9, 100]
    got = {r.q: r.value for r in H.percentiles(values(spark, numbers), [*wanted, 50]).collect()}
    assert list(got) == [float(q) for q in wanted]
    assert np.allclose([got[q] for q in wanted], np.percentile(numbers, wanted))


def test_percentiles_reject_bad_requests(spark):
    for bad in (-1, 101, math.nan):
        with pytest.raises(ValueError):
            H.percentiles(values(spark, [1.0]), [bad])


def test_default_scale(spark):
    rows = [
        ("fits", "a", 0, None, 8192, 8192), ("fits", "b", 1, None, 2048, 2048), ("fits", "c", 2, None, 4096, 4096),
        ("large", "a", 0, None, 9000, 9000), ("large", "b", 1, None, 8000, 8000),
        ("deep", "a", 0, 4, 4096, 4096), ("deep", "b", 1, 4, 1024, 1024), ("tie", "a", 0, None, 10, 20), ("tie", "b", 1, None, 20, 10),
    ]
    df = spark.createDataFrame(rows, "image string, scale string, pos long, z long, y long, x long")
    assert {r.image: r.scale for r in R.default_scale(df).collect()} == {"fits": "c", "large": "b", "deep": "b", "tie": "a"}


def test_channel_scan_and_guards(spark):
    df = spark.createDataFrame([("i", "scale0", "a", 1.0), ("i", "scale1", "a", 2.0), ("i", "scale0", "b", 3.0)], "image string, scale string, channel string, value double")
    assert [r.value for r in R.scan_image_channel(df, "i", "a").collect()] == [1.0]
    declared = df.select("image", "scale", "channel")
    R.require_channel(declared, "i", "a", "scale1")
    for args in (("i", "c", None), ("i", "b", "scale1"), ("i", "a", "scale9")):
        with pytest.raises(ValueError):
            R.require_channel(declared, *args)
    with pytest.raises(ValueError, match="several"):
        R.require_channel(declared.union(declared), "i", "a")


def raster(spark, grid, region="r"):
    rows = [(region, int(v), int(y), int(x)) for y, line in enumerate(grid) for x, v in enumerate(line)]
    return R.scan_labels_pixels(spark.createDataFrame(rows, "region string, label long, y long, x long"))


GRID = np.array([[0, 1, 1, 0, 2], [1, 1, 1, 0, 2], [0, 1, 0, 0, 2], [3, 0, 0, 2, 2]])


def test_centers_are_mean_pixel_indices(spark):
    wanted = spark.createDataFrame([("r", 1), ("r", 2), ("r", 3), ("r", 9)], "region string, instance_id long")
    found = X.canonical_centers(raster(spark, GRID), wanted)
    got = {r.instance_id: (r.cz, r.cy, r.cx) for r in found.collect()}
    for label in (1, 2, 3):
        y, x = np.argwhere(GRID == label).mean(axis=0)
        assert got[label] == (0.0, pytest.approx(y), pytest.approx(x))
    assert [r.instance_id for r in X.missing_centers(found).collect()] == [9]


def test_labels_must_be_integers_with_axes(spark):
    with pytest.raises(ValueError):
        R.scan_labels_pixels(spark.createDataFrame([(1.0, 0, 0)], "label double, y long, x long"))
    with pytest.raises(ValueError):
        R.scan_labels_pixels(spark.createDataFrame([(1, 0)], "label long, y long"))
    assert R.label_dtype(spark.createDataFrame([(1,)], "label short")) == "int16"
    assert X.ids_beyond_dtype(spark.createDataFrame([(200,), (100,)], "instance_id long"), "int8").count() == 1


def brute_perimeter(mask):
    padded = np.pad(mask.astype(int), 2)
    core = padded[1:-1, 1:-1]
    inner = core & padded[:-2, 1:-1] & padded[2:, 1:-1] & padded[1:-1, :-2] & padded[1:-1, 2:]
    border = np.pad(core - inner, 1)
    total = 0.0
    for y in range(1, border.shape[0] - 1):
        for x in range(1, border.shape[1] - 1):
            if border[y, x]:
                around = border[y - 1 : y + 2, x - 1 : x + 2]
                w = int((around * np.array([[10, 2, 10], [2, 1, 2], [10, 2, 10]])).sum())
                total += {5: 1, 7: 1, 15: 1, 17: 1, 25: 1, 27: 1, 21: 2**0.5, 33: 2**0.5, 13: (1 + 2**0.5) / 2, 23: (1 + 2**0.5) / 2}.get(w, 0)
    return total


def disc(radius):
    y, x = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    return (y * y + x * x <= radius * radius).astype(int)


def cross_product(o, a, b):
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def brute_hull(mask):
    """Pixels whose center lies in the convex hull of all pixel diamonds, tested against every pair of hull points."""
    points = [(y + dy, x + dx) for y, x in np.argwhere(mask) for dy, dx in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))]
    points = sorted(set(points))

    def half(items):
        kept = []
        for p in items:
            while len(kept) >= 2 and cross_product(kept[-2], kept[-1], p) <= 0:
                kept.pop()
            kept.append(p)
        return kept[:-1]

    hull = half(points) + half(points[::-1])
    inside = [
        (y, x) for y in range(mask.shape[0]) for x in range(mask.shape[1])
        if all(cross_product(hull[i], hull[(i + 1) % len(hull)], (y, x)) >= -1e-9 for i in range(len(hull)))
    ]
    return len(inside), np.mean(inside, axis=0)


BLOB = (np.array([[math.sin(i * 0.7) * j % 5 > 1.5 for j in range(14)] for i in range(12)])).astype(int)


@pytest.mark.parametrize("mask", [GRID == 1, GRID == 2, disc(6), np.ones((4, 7)), np.ones((1, 1)), BLOB], ids=["one", "two", "disc", "box", "dot", "blob"])
def test_shape_features_match_brute_force(spark, mask):
    mask = np.asarray(mask).astype(int)
    row = X.morphology_features(raster(spark, mask)).first()
    ys, xs = np.nonzero(mask)
    area = mask.sum()
    covariance = np.array([[ys.var() + 1 / 12, np.mean((ys - ys.mean()) * (xs - xs.mean()))], [0, xs.var() + 1 / 12]])
    covariance[1, 0] = covariance[0, 1]
    small, large = np.linalg.eigvalsh(covariance)
    hull, center = brute_hull(mask)
    assert row.area == area and row.perimeter == pytest.approx(brute_perimeter(mask))
    assert row.major_axis_length == pytest.approx(4 * math.sqrt(large)) and row.minor_axis_length == pytest.approx(4 * math.sqrt(small))
    assert row.eccentricity == pytest.approx(math.sqrt(max(0, 1 - small / large)), abs=1e-6)
    assert row.equivalent_diameter == pytest.approx(math.sqrt(4 * area / math.pi))
    assert row.convex_area == hull and row.convex_hull_resid == pytest.approx((hull - area) / hull)
    assert row.centroid_dif == pytest.approx(math.hypot(ys.mean() - center[0], xs.mean() - center[1]) / math.sqrt(area), abs=1e-9)


def test_shapes_across_words_and_repeated_pixels(spark):
    """Objects that cross the ends of words at 64 pixels, touch diagonally there, and whose pixels come once per channel."""
    rng = np.random.default_rng(3)
    masks = {1: np.zeros((9, 200), int), 2: (rng.random((12, 140)) < 0.7).astype(int), 3: np.zeros((6, 130), int), 4: disc(40)}
    masks[1][2:7, 60:131] = 1
    masks[3][1, 63] = masks[3][2, 64] = masks[3][3, 63] = masks[3][3, 127] = masks[3][4, 128] = masks[3][2, 128] = 1
    rows = [("r", k, int(y), int(x) + k, c) for k, m in masks.items() for y, x in np.argwhere(m) for c in ("a", "b")]
    df = spark.createDataFrame(rows, "region string, label long, y int, x int, channel string").repartition(7)
    for row in X.morphology_features(df).collect():
        mask = masks[row.label]
        ys, xs = np.nonzero(mask)
        hull, center = brute_hull(mask)
        assert row.area == mask.sum() and row.perimeter == pytest.approx(brute_perimeter(mask))
        assert row.convex_area == hull and row.centroid_dif == pytest.approx(math.hypot(ys.mean() - center[0], xs.mean() - center[1]) / math.sqrt(mask.sum()), abs=1e-9)
        covariance = np.cov(ys, xs, bias=True) + np.eye(2) / 12
        assert row.major_axis_length == pytest.approx(4 * math.sqrt(np.linalg.eigvalsh(covariance)[1]))


def test_far_away_objects_keep_their_shape(spark):
    """Sums of squares near 2**52 leave the moments of a small object exact."""
    rows = [("r", 1, y + 2**27 - 3, x + 2**27 - 5) for y in range(3) for x in range(7)]
    row = X.morphology_features(spark.createDataFrame(rows, "region string, label long, y long, x long")).first()
    assert row.major_axis_length == pytest.approx(4 * math.sqrt((49 - 1) / 12 + 1 / 12)) and row.minor_axis_length == pytest.approx(4 * math.sqrt((9 - 1) / 12 + 1 / 12))
    assert row.convex_area == 21 and row.centroid_dif == pytest.approx(0)


def test_intensity_features(spark):
    rows = [("r", 1, i, 0, c, float(v)) for c, vs in {"a": [1, 2, 3, 10], "b": [4, 4, 6, 6]}.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "region string, label long, y long, x long, channel string, value double")
    features = X.intensity_features(df, ["b", "a"], ["mean", "var", "kurtosis", "skew"])
    assert features.columns[2:] == [f"{f}__{c}" for f in ("mean", "var", "kurtosis", "skew") for c in ("b", "a")]
    row, v = features.first(), np.array([1, 2, 3, 10.0])
    assert row.mean__a == v.mean() and row.var__a == pytest.approx(v.var())
    z = (v - v.mean()) / v.std()
    assert row.skew__a == pytest.approx((z**3).mean()) and row.kurtosis__a == pytest.approx((z**4).mean() - 3)
    for bad in ({"channels": ["a", "a"]}, {"channels": ["a"], "features": ["median"]}):
        with pytest.raises(ValueError):
            X.intensity_features(df, **bad)


def test_sketches_merge_across_images(spark):
    n = 60_000
    df = spark.range(0, n, 1, 6).select(
        F.concat(F.lit("c"), F.col("id") % 2).alias("channel"), (F.col("id") % 7).alias("image"), (F.xxhash64("id") % 1_000_003).alias("value"))
    sketches = H.percentile_sketches(df.unionByName(df.limit(1).withColumn("value", F.lit(None).cast("long"))), "channel", "image")
    merged = H.merged_sketches(sketches, "channel")
    values = {c: np.sort([r.value for r in df.where(F.col("channel") == c).collect()]) for c in ("c0", "c1")}
    for row in H.sketch_percentiles(merged, [0, 1, 50, 99, 100], "channel").collect():
        rank = np.searchsorted(values[row.channel], row.value) / (n / 2)
        assert abs(rank - row.q / 100) <= 2 * H.RANK_ERROR
    assert {r.n for r in merged.select(F.kll_sketch_get_n_double("sketch").alias("n")).collect()} == {n // 2}
    odd = spark.createDataFrame([("a", float("nan")), ("a", None), ("b", 3.0)], "channel string, value double")
    got = {r.channel: r.value for r in H.sketch_percentiles(H.percentile_sketches(odd, "channel"), [50], "channel").collect()}
    assert got == {"a": None, "b": 3.0}
