import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae import scale
from tesserae.functions.palette import DISTINCT_COLORS, NEUTRAL_COLOR
from tesserae.operators import encode as E
from tesserae.operators import regions as G
from tesserae.sources import catalog as K
from tesserae.sources import tables as T

OBS = "region string, instance_id long"


def attributes(region="area", instance="cell", regions=("a", "b")):
    return {"region_key": region, "instance_key": instance, "region": regions}


def test_object_keys_follow_the_rules():
    assert T.object_keys(attributes()) == T.ObjectKeys("area", "cell", ("a", "b"))
    assert T.object_keys(attributes(regions="ab")).regions == ("ab",)
    bad = [
        attributes(region=""), attributes(region=["r", "s"]), attributes(instance=None), attributes(instance="area"), attributes(regions=["a", "a"]),
        attributes(regions=[""]), attributes(regions=[]), attributes(regions=None), attributes(regions=[1]), {},
    ]
    for given in bad:
        with pytest.raises(ValueError):
            T.object_keys(given)


def test_table_scan_needs_its_keys(spark):
    df = spark.createDataFrame([("a", 1)], "area string, cell long")
    assert T.scan_obs_table(df, T.object_keys(attributes())).columns == ["region", "instance_id"]
    with pytest.raises(ValueError, match="cell_id"):
        T.scan_obs_table(df, T.object_keys(attributes(instance="cell_id")))


def test_requested_regions():
    assert G.requested_regions(["b", "a", "b"], ("a", "b", "c")) == ["b", "a"]
    assert G.requested_regions("a", ("a",)) == ["a"]
    for bad in ([], [""], ["z"]):
        with pytest.raises(ValueError):
            G.requested_regions(bad, ("a", "b"))


def test_region_filter_by_table(spark):
    obs = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], OBS)
    wanted = spark.createDataFrame([("a",), ("c",), ("a",)], "region string")
    assert sorted(r.instance_id for r in G.region_filter(obs, wanted).collect()) == [1, 3]


def test_duplicates_with_preview(spark):
    rows = [("a", i % 8) for i in range(16)] + [("b", 1), ("b", 1), ("b", 2), ("c", 1)]
    got = {r.region: (r.n_duplicates, r.preview) for r in G.duplicate_instances(spark.createDataFrame(rows, OBS)).collect()}
    assert got == {"a": (8, "0, 1, 2, 3, 4"), "b": (1, "1")}


def test_positive_instances(spark):
    texts = ["3", "3.9", " 4 ", "0", "-2", "x", None, "nan", "inf", "1e2"]
    df = spark.createDataFrame([("a", t) for t in texts], "region string, instance_id string")
    assert sorted(r.instance_id for r in G.positive_instances(df).collect()) == [3, 3, 4, 100]
    assert [r.instance_id for r in G.duplicate_positive_instances(df).collect()] == [3]


def shapes_and_rows(spark, shape_ids, row_ids):
    return spark.createDataFrame([(i,) for i in shape_ids], "instance_id string"), spark.createDataFrame(
        [(i, k) for k, i in enumerate(row_ids)], "instance_id string, v long"
    )


@pytest.mark.parametrize("small", [True, False])
def test_alignment_allows_repeated_shapes(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
    shapes, rows = shapes_and_rows(spark, ["s1", "s1", "s2", "s3"], ["s1", "s3"])
    got = sorted(((r.instance_id, r.v, r.has_table_row) for r in G.align_table_to_shapes(shapes, rows).collect()), key=str)
    assert got == [("s1", 0, True), ("s1", 0, True), ("s2", None, False), ("s3", 1, True)]
    assert G.alignment_problems(shapes, rows).first()["problem"] is None


@pytest.mark.parametrize(
    "shape_ids, row_ids, problem",
    [
        (["a", None], ["a"], "missing_shape_instances"), (["a"], [], "no_table_rows"), (["a"], ["a", None], "missing_table_instances"),
        (["a"], ["a", "a"], "duplicate_table_instances"), (["a"], ["a", "b"], "instances_without_shape"),
    ],
)
def test_alignment_rejections(spark, shape_ids, row_ids, problem):
    assert G.alignment_problems(*shapes_and_rows(spark, shape_ids, row_ids)).first()["problem"] == problem


def test_feature_merge(spark):
    obs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], OBS)
    kind = OBS + ", features array<double>"
    new = spark.createDataFrame([("a", 1, [1.0, 2.0])], kind)
    old = spark.createDataFrame([("a", 2, [5.0, 5.0]), ("b", 1, [7.0, 8.0])], kind)

    def merged(**options):
        rows = G.merge_feature_matrix(obs, new, width=2, **options).orderBy("region", "instance_id").collect()
        return [[None if math.isnan(v) else v for v in r.features] for r in rows]

    assert merged(old=None, same_schema=False) == [[1.0, 2.0], [None, None], [None, None]]
    assert merged(old=old, same_schema=True, overwrite=True) == [[1.0, 2.0], [None, None], [7.0, 8.0]]
    assert merged(old=old, same_schema=False, overwrite=True) == [[1.0, 2.0], [None, None], [None, None]]
    with pytest.raises(ValueError, match="overwrite"):
        merged(old=old, same_schema=True)


def test_second_region_and_random_features(spark):
    obs = spark.createDataFrame([("a", 1), ("a", 2)], OBS)
    both = G.duplicate_into_region(obs, "a_2")
    assert both.count() == 4 and both.where("region = 'a_2'").count() == 2
    assert all(len(r.features) == 3 for r in G.random_features(obs, 3).collect())


def test_expand_and_skip(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    df = spark.createDataFrame(
        [("a", [[ring], [ring]]), ("b", []), ("c", None)], "id string, parts array<array<array<struct<x:double,y:double>>>>"
    )
    assert [(r.id, r.part) for r in G.expand_rendered_rows(df).orderBy("id", "part").collect()] == [("a", 0), ("a", 1)]
    assert G.skipped_shapes(df).first()[0] == 2


def test_edited_rows_keep_integers(spark):
    source = spark.createDataFrame([("a", 1, True), ("b", 2, False)], "instance_id string, n long, flag boolean")
    edited = spark.createDataFrame([("b",), ("new",)], "instance_id string")
    got = {r.instance_id: (r.n, r.flag) for r in G.realign_edited_shapes(edited, source).collect()}
    assert got == {"b": (2, False), "new": (None, None)}


def categories(spark, items):
    return spark.createDataFrame([(i, c) for i, c in enumerate(items)], "pos long, category string")


def palette(spark, pairs):
    return spark.createDataFrame([(i, c, v) for i, (c, v) in enumerate(pairs)], "pos long, category string, color string")


def test_column_kinds(spark):
    df = spark.createDataFrame(
        [(True, 0, 5, 1.5, "s", None, "r", 1, 1, "#fff"), (False, 1, 6, 2.5, None, None, "r", 2, 1, "#fff")],
        "b boolean, bin long, n long, f double, s string, nothing string, region string, instance_id long, one long, s_color string",
    )
    got = {r.column: r.kind for r in E.classify_column_kind(df, categorical=["n"], instance_key="instance_id", skip=["region"]).collect()}
    assert got == {
        "b": "categorical", "bin": "categorical", "n": "categorical", "f": "continuous", "s": "categorical", "nothing": "none",
        "instance_id": "instance", "one": "continuous", "s_color": "categorical",
    }
    assert "s_color" not in {r.column for r in E.classify_column_kind(df, shape_columns=True).collect()}


@pytest.mark.parametrize("ranges", [None, 5])
def test_first_seen_order(spark, monkeypatch, ranges):
    if ranges:
        monkeypatch.setattr(scale, "ROWS_PER_RANGE", ranges)
    values = [f"v{(i * 7) % 31}" for i in range(100)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None])], "row_pos long, value string").repartition(5)
    got = [r.category for r in E.first_seen_categories(df, "value").orderBy("pos").collect()]
    assert got == list(dict.fromkeys(values))


def test_typed_categories(spark):
    df = spark.createDataFrame([(0, True, 1, "b", 0.5), (1, True, 1, "a", 1.5)], "row_pos long, t boolean, one long, s string, f double")
    names = lambda c: [r.category for r in E.typed_category_values(df, c).orderBy("pos").collect()]
    assert names("t") == ["true"] and names("one") == ["1"] and names("s") == ["b", "a"]
    with pytest.raises(ValueError, match="continuous"):
        E.typed_category_values(df, "f")
    declared = categories(spark, ["x", "y"])
    assert E.typed_category_values(df, "s", vocabulary=declared).count() == 2


def test_codes_share_colors(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["a", "b", "c", "d", "zz", None])], "id long, v string")
    colors = palette(spark, [("a", "#FF0000"), ("b", "#f00"), ("c", "#00000000"), ("d", NEUTRAL_COLOR)])
    got = {r.id: r.code for r in E.categorical_codes(df, "v", colors).collect()}
    assert got == {0: 2, 1: 2, 2: 1, 3: 3, 4: 3, 5: 3}
    plain = palette(spark, [("a", "#FF0000"), ("b", "#00FF00")])
    assert {r.id: r.code for r in E.categorical_codes(df, "v", plain).collect()} == {0: 2, 1: 3, 2: 4, 3: 4, 4: 4, 5: 4}


def test_continuous_codes(spark):
    numbers = [0.0, 0.5, 1.0, float("nan"), float("inf"), None, 0.999]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(numbers)], "id long, v double")
    got = {r.id: r.code for r in E.continuous_codes(df, "v", bins=4).collect()}
    assert got == {0: 2, 1: 4, 2: 5, 3: 6, 4: 6, 5: 6, 6: 5}
    fixed = {r.id: r.code for r in E.continuous_codes(df, "v", bins=4, fixed_range=(0.5, 0.6)).collect()}
    assert fixed[0] == 2 and fixed[2] == 5
    constant = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert {r.code for r in E.continuous_codes(constant, "v", bins=4).collect()} == {4}
    assert {r.normalized for r in E.normalized_values(constant, "v").collect()} == {0.5}
    for options in ({"bins": 1}, {"bins": True}, {"fixed_range": (1, 1)}):
        with pytest.raises(ValueError):
            E.continuous_codes(df, "v", **options)


def test_palette_sources(spark):
    vocabulary = spark.createDataFrame([(c, p, f"{c}{p}") for c in "abcd" for p in range(2)], "column string, pos long, category string")
    stored = spark.createDataFrame(
        [("a", 0, "red"), ("a", 1, "#123456"), ("b", 0, "#123456"), ("c", 0, "#123456"), ("c", 1, "nope")], "column string, pos long, color string"
    )
    rows = E.resolve_palette(vocabulary, stored).orderBy("column", "pos").collect()
    assert [r.source for r in rows[::2]] == ["stored", "default_invalid", "default_invalid", "default_missing"]
    assert [r.color for r in rows[:4]] == ["red", "#123456", *DISTINCT_COLORS[:2]]


def test_companion_palette(spark):
    df = spark.createDataFrame(
        [("a", "#F00", "#111111", None), ("a", "#ff0000", "#222222", "#111111"), ("b", "#00f", "#333333", "#222222"), (None, "#zzz", None, "bad")],
        "v string, same string, mixed string, partly string",
    )
    names = categories(spark, ["a", "b"])
    good = E.companion_palette(df, names, "v", "same").orderBy("pos").collect()
    assert {r.source for r in good} == {"stored"} and good[1].color == "#00f"
    assert {r.source for r in E.companion_palette(df, names, "v", "mixed").collect()} == {"default_invalid"}
    assert {r.source for r in E.companion_palette(df, names, "v", "partly").collect()} == {"stored"}
    assert {r.source for r in E.companion_palette(df, categories(spark, ["a", "c"]), "v", "same").collect()} == {"default_invalid"}
    assert {r.source for r in E.companion_palette(df, names, "v", None).collect()} == {"default_missing"}


def test_vocabulary_growth(spark):
    current = spark.createDataFrame([(0, 5), (1, 2)], "pos long, category long")
    seen = spark.createDataFrame([(9,), (2,), (3,), (None,), (9,)], "category long")
    grown = E.append_vocabulary(current, seen)
    assert [r.category for r in grown.orderBy("pos").collect()] == [5, 2, 3, 9]
    colored = E.extend_palette(grown, spark.createDataFrame([(0, "#aaa"), (1, "#bbb")], "pos long, color string")).orderBy("pos").collect()
    assert [r.color for r in colored] == ["#aaa", "#bbb", DISTINCT_COLORS[2], DISTINCT_COLORS[3]]
    assert sorted(r.category for r in E.class_difference(seen, current).collect()) == [3, 9]


def test_color_cycle(spark):
    found = spark.range(0, 206).select("id", E.default_color(F.col("id")).alias("c")).collect()
    assert found[0].c is None and found[1].c == found[103].c == DISTINCT_COLORS[0] and found[102].c == DISTINCT_COLORS[101]


def test_identity_codes(spark):
    df = spark.createDataFrame([(0, "b", 7), (1, None, None), (2, "a", 9), (3, "b", 7)], "row_pos long, s string, n long")
    assert [r.code for r in E.instance_identity_codes(df, "s").orderBy("row_pos").collect()] == [1, 0, 2, 1]
    assert [r.code for r in E.instance_identity_codes(df, "n").orderBy("row_pos").collect()] == [7, 0, 9, 7]
    zero = df.withColumn("n", F.col("n") - 7)
    assert [r.code for r in E.instance_identity_codes(zero, "n").orderBy("row_pos").collect()] == [1, 0, 2, 1]


def test_stable_point_colors(spark):
    few = spark.createDataFrame([("b", 0), ("a", 1), ("b", 5)], "value string, use_pos long")
    assert {r.value: r.color for r in E.points_color_plan(few).collect()} == {"b": DISTINCT_COLORS[0], "a": DISTINCT_COLORS[1]}
    many = spark.range(103).select(F.col("id").cast("string").alias("value"), F.col("id").alias("use_pos"))
    assert {(r.color, r["mode"]) for r in E.points_color_plan(many).collect()} == {("#00FFFF", "solid")}


def test_annotation_columns(spark):
    rows = [("t", "x", "string"), ("i", "1", "integer"), ("i", "2", "integer"), ("zero", "0", "integer"), ("mix", "1", "integer"), ("mix", "x", "string"), ("pred_class", "1", "integer")]
    df = spark.createDataFrame(rows, "column string, category string, kind string")
    got = {r.column: r.value_kind for r in E.compatible_annotation_columns(df, ["pred_class"]).collect()}
    assert got == {"t": "string", "i": "positive_integer"}


def test_catalog_matching(spark):
    rows = [
        ("l", "labels", "g", 1.0, 0.0, 0.0, 1.0, 5.0, 0.0, None, None, 10, 10), ("l2", "labels", "g", 2.0, 0.0, 0.0, 1.0, 0.0, 0.0, None, None, 10, 10),
        ("i", "images", "g", 1.0, 0.0, 0.0, 1.0, 5.0 + 1e-9, 0.0, None, None, 10, 10), ("far", "images", "g", 1.0, 0.0, 0.0, 1.0, 6.0, 0.0, None, None, 10, 10),
        ("size", "images", "g", 1.0, 0.0, 0.0, 1.0, 5.0, 0.0, None, None, 9, 10), ("deep", "images", "g", 1.0, 0.0, 0.0, 1.0, 5.0, 0.0, 2.0, 3, 10, 10),
        ("L", "shapes", "h", 1.0, 0.0, 0.0, 1.0, 5.0, 0.0, None, None, 10, 10),
    ]
    schema = "element string, kind string, coordinate_system string, a double, b double, d double, e double, xoff double, yoff double, zoff double, nz long, ny long, nx long"
    df = spark.createDataFrame(rows, schema)
    assert [(r.labels, r.image) for r in K.match_images_to_labels(df).collect()] == [("l", "i")]
    found = {r.labels: (r.matching, r.images, r.unavailable) for r in K.image_discovery(df).collect()}
    assert found == {"l": (1, 4, 3), "l2": (0, 4, 4)}
    assert tuple(K.labels_in_coordinate_system(df).first()) == ("g", 1, 1, 2)
    assert [r.folded for r in K.name_collisions(df).collect()] == ["l"]
    with pytest.raises(ValueError):
        K.element_catalog(df, "movies")


def test_equal_shifts_meet_in_cells(spark):
    rng = np.random.default_rng(2)
    shifts = [0.0, 1e-9, -1e-9, 5e-9, 1.0, -1.0, 2.0, 4.0, 1023.99999, 1024.0, 1e9, -3.3e5, *(rng.random(30) * 10.0 ** rng.integers(-9, 9, 30))]
    near = [s + (1e-8 + 1e-5 * abs(s)) * f for s in shifts for f in (-1.5, -0.999, 0.0, 0.7, 0.999, 1.5)]
    schema = "element string, kind string, coordinate_system string, a double, b double, d double, e double, xoff double, yoff double, zoff double, nz long, ny long, nx long"
    row = lambda name, kind, x, y: (name, kind, "g", 1.0, 0.0, 0.0, 1.0, float(x), float(y), None, None, 10, 10)
    rows = [row(f"l{i}", "labels", x, -x) for i, x in enumerate(shifts)] + [row(f"i{j}", "images", x, -x) for j, x in enumerate(near)]
    want = {(f"l{i}", f"i{j}") for i, a in enumerate(shifts) for j, b in enumerate(near) if abs(b - a) <= 1e-8 + 1e-5 * abs(a)}
    got = [(r.labels, r.image) for r in K.match_images_to_labels(spark.createDataFrame(rows, schema)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def sent_whole(plan: str) -> list[str]:
    """Lines of a physical plan below a broadcast exchange."""
    found, depth = [], None
    for line in plan.splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at > depth:
            found.append(line)
            continue
        depth = at if "BroadcastExchange" in line else None
    return found


def test_many_elements_in_one_place(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(K, "PAIRS_TOGETHER", 100, raising=False)
    schema = "element string, kind string, coordinate_system string, a double, b double, d double, e double, xoff double, yoff double, zoff double, nz long, ny long, nx long"
    row = lambda name, kind, a, x: (name, kind, "g", a, 0.0, 0.0, 1.0, x, 0.0, None, None, 10, 10)
    rows = [row(f"l{i % 39}", "labels", 1.0, 5.0) for i in range(40)] + [row(f"i{j}", "images", 1.0, 5.0 + j % 2 * 1e-9) for j in range(50)]
    rows += [row("wide", "labels", 2.0, 5.0), row("none", "labels", 1.0, None), row("far", "images", 1.0, 9.0), row("lost", "images", 1.0, None)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "catalog"))
    df = spark.read.parquet(str(tmp_path / "catalog"))
    for function in (K.match_images_to_labels, K.image_discovery):
        assert not [line for line in sent_whole(function(df)._jdf.queryExecution().executedPlan().toString()) if "Generate" in line]
    got = sorted((r.labels, r.image) for r in K.match_images_to_labels(df).collect())
    assert got == sorted((f"l{i % 39}", f"i{j}") for i in range(40) for j in range(50))
    found = {r.labels: (r.matching, r.images, r.unavailable) for r in K.image_discovery(df).collect()}
    assert found == {f"l{i}": (50, 52, 2) for i in range(1, 39)} | {"l0": (100, 52, -48), "wide": (0, 52, 52), "none": (0, 52, 52)}
