import math
import random

import pytest
from pyspark.sql import functions as F

from tesserae import scale
from tesserae.functions.geometry import ellipse_ring
from tesserae.functions.numeric import Affine
from tesserae.operators import shapes as S
from tesserae.operators import spatial as G

POLYGONS = "polygon_id long, rings array<array<struct<x:double,y:double>>>"


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def polygons(spark, *rings):
    return spark.createDataFrame([(i, [[tuple(map(float, p)) for p in ring] for ring in r]) for i, r in enumerate(rings)], POLYGONS)


def points(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in rows], "id long, x double, y double")


TRUTH = [(5, (1, 1)), (2, (0, 5)), (9, (3, 5)), (4, (5, 5)), (7, (15, 15)), (6, (21, 21)), (11, (100, 100))]


@pytest.mark.parametrize("broadcast", [True, False])
def test_truth_table(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(scale, "HOT_ROWS", 1)
    shapes = polygons(spark, [box(0, 0, 10, 10), box(3, 3, 7, 7)], [box(20, 20, 22, 22)])
    assert [r.id for r in G.matched_ids(points(spark, TRUTH), shapes, ["id"]).collect()] == [2, 5, 6, 9]
    inside = {r.id: r.in_union for r in G.union_membership(points(spark, TRUTH), shapes, ["id"]).collect()}
    assert inside == {i: i in (2, 5, 6, 9) for i, _ in TRUTH}


def test_a_hole_filled_by_another_polygon_is_inside(spark):
    shapes = polygons(spark, [box(0, 0, 10, 10), box(3, 3, 7, 7)], [box(4, 4, 6, 6)])
    assert [r.id for r in G.matched_ids(points(spark, [(1, (5, 5)), (2, (3.5, 5))]), shapes, ["id"]).collect()] == [1]


@pytest.mark.parametrize(
    "affine, inside, outside",
    [
        (Affine(xoff=10, yoff=20), (11, 21), (1, 1)),
        (Affine(a=3, e=0.5), (5, 0.9), (5, 1.1)),
        (Affine(a=0, b=-1, d=1, e=0), (-1, 1), (1, 1)),
        (Affine(a=-1), (-1, 1), (1, 1)),
    ],
)
def test_affines(spark, affine, inside, outside):
    shapes = polygons(spark, [box(0, 0, 2, 2)])
    found = G.matched_ids(points(spark, [(1, inside), (2, outside)]), shapes, ["id"], affine=affine)
    assert [r.id for r in found.collect()] == [1]
    x, y = inside
    back = affine.inverse().after(affine)
    assert (back.a, back.b, back.d, back.e, back.xoff, back.yoff) == pytest.approx((1, 0, 0, 1, 0, 0))


def star(cx, cy, radius, corners, turn):
    ring = [
        (cx + math.cos(turn + i * math.pi / corners) * radius * (1 if i % 2 else 0.4), cy + math.sin(turn + i * math.pi / corners) * radius * (1 if i % 2 else 0.4))
        for i in range(2 * corners)
    ]
    return ring + ring[:1]


def inside_ring(ring, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def test_mixed_sizes_against_brute_force(spark):
    """Stars from 0.1 to 500 across, so that several cell sizes are in use."""
    rng = random.Random(5)
    rings = [star(rng.uniform(0, 1000), rng.uniform(0, 1000), 10 ** rng.uniform(-1, 2.4), rng.randint(3, 9), rng.uniform(0, 6)) for _ in range(60)]
    spots = [(i, (rng.uniform(0, 1000), rng.uniform(0, 1000))) for i in range(800)]
    spots += [(1000 + i, (r[0][0] * 0.5 + r[2][0] * 0.5, r[0][1] * 0.5 + r[2][1] * 0.5)) for i, r in enumerate(rings)]
    want = sorted(i for i, (x, y) in spots if any(inside_ring(r, x, y) for r in rings))
    found = G.points_in_polygons(points(spark, spots).repartition(3), polygons(spark, *[[r] for r in rings]), ["id"])
    assert sorted(r.id for r in found.collect()) == want and len(want) > 50


@pytest.mark.parametrize("names", [("cx", "cy"), ("level", "min_x")])
def test_any_coordinate_names(spark, monkeypatch, names):
    x, y = names
    df = points(spark, [(1, (0.5, 0.5)), (2, (10.4, 0.5)), (3, (9.9, 9.9))]).withColumnsRenamed({"x": x, "y": y})
    found = G.points_in_polygons(df, polygons(spark, [box(0, 0, 10, 10)]), ["id"], x=x, y=y)
    assert found.columns == df.columns and sorted(map(tuple, found.collect())) == [(1, 0.5, 0.5), (3, 9.9, 9.9)]


def test_no_polygons(spark):
    assert G.points_in_polygons(points(spark, TRUTH), spark.createDataFrame([], POLYGONS), ["id"]).count() == 0


def test_validation_codes(spark):
    cases = [
        ([box(0, 0, 4, 4)], None),
        ([box(0, 0, 4, 4), box(1, 1, 2, 2)], None),
        ([[(0, 0), (4, 4), (4, 0), (0, 6), (0, 0)]], "self_intersection"),
        ([[(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)]], "self_intersection"),
        ([[(0, 0), (4, 0), (4, 4), (4, 2), (4, 5), (0, 4), (0, 0)]], "self_intersection"),
        ([box(0, 0, 4, 4)[:-1]], "not_closed"),
        ([[(0, 0), (4, 0), (0, 0)]], "too_few_vertices"),
        ([[(0, 0), (2, 2), (4, 4), (0, 0)]], "no_area"),
        ([[(0, 0), (float("nan"), 0), (4, 4), (0, 0)]], "not_finite"),
        ([], "empty"),
        ([box(0, 0, 4, 4), box(3, 3, 5, 5)], "ring_crossing"),
        ([box(0, 0, 4, 4), box(6, 6, 7, 7)], "hole_outside"),
        ([box(0, 0, 4, 4), [(2, 0), (3, 1), (1, 1), (2, 0)]], None),
    ]
    found = {r.polygon_id: r.problem for r in G.validate_polygons(polygons(spark, *[c for c, _ in cases])).collect()}
    assert found == {i: p for i, (_, p) in enumerate(cases)}


def crossing_pairs(edges):
    def side(o, a, b):
        return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    n = 0
    for i in range(len(edges)):
        for j in range(i + 1, len(edges)):
            (a, b), (c, d) = edges[i], edges[j]
            n += side(c, d, a) * side(c, d, b) < 0 and side(a, b, c) * side(a, b, d) < 0
    return n


def test_edge_contacts_find_every_crossing_once(spark):
    """Short and long random edges: the pairs found through cells are those of an exhaustive check."""
    rng = random.Random(11)
    edges = []
    for _ in range(150):
        x, y, length, turn = rng.uniform(0, 100), rng.uniform(0, 100), 10 ** rng.uniform(-0.5, 2), rng.uniform(0, 6.3)
        edges.append(((x, y), (x + math.cos(turn) * length, y + math.sin(turn) * length)))
    rows = [(0, i, 0, 1, 0, *a, *b) for i, (a, b) in enumerate(edges)]
    df = spark.createDataFrame(rows, "g long, owner long, ring int, n int, k int, x1 double, y1 double, x2 double, y2 double")
    found = G.edge_contacts(df, ["g"], "owner").where("kind = 'cross'")
    assert found.count() == found.select("a_owner", "b_owner").distinct().count() == crossing_pairs(edges) > 50


def test_holes(spark):
    shell = box(0, 0, 20, 20)
    cases = {
        "fine": ([shell], [box(1, 1, 3, 3)], [box(5, 5, 8, 8)]),
        "corner": ([shell], [box(1, 1, 3, 3)], [box(3, 3, 6, 6)]),
        "edge": ([shell], [box(1, 1, 3, 3)], [box(3, 1, 6, 3)]),
        "overlap": ([shell], [box(1, 1, 4, 4)], [box(3, 3, 6, 6)]),
        "nested": ([shell], [box(1, 1, 9, 9)], [box(3, 3, 6, 6)]),
        "thrice": ([shell], [box(1, 1, 4, 4)], [box(1, 1, 4, 4)], [box(1, 1, 4, 4)]),
        "same": ([shell], [box(1, 1, 9, 9)], [box(1, 1, 9, 9)]),
        "outside": ([shell], [box(30, 1, 33, 3)]),
        "across": ([shell], [box(18, 1, 23, 3)]),
        "touch": ([shell], [box(0, 1, 3, 3)]),
        "tie": ([shell], [box(40, 40, 60, 60)]),
        "alone": ([shell],),
        "holed": ([shell], [box(1, 1, 9, 9), box(2, 2, 3, 3)]),
        "kept": ([shell, box(1, 1, 9, 9)], [box(12, 12, 15, 15)]),
        "kept_nested": ([shell, box(1, 1, 9, 9)], [box(3, 3, 6, 6)]),
    }
    rows = [(g, i, [[tuple(map(float, p)) for p in ring] for ring in r]) for g, case in cases.items() for i, r in enumerate(case)]
    df = spark.createDataFrame(rows, "group_id string, " + POLYGONS)
    found = {r.group_id: r.problem for r in G.assemble_holes(df).collect()}
    assert found == {
        "fine": None, "corner": None, "edge": "overlap", "overlap": "overlap", "nested": "nested", "same": "overlap", "thrice": "overlap", "outside": "not_contained",
        "across": "not_contained", "touch": "touches_shell", "tie": "ambiguous_shell", "alone": "too_few_polygons", "holed": "hole_has_interiors",
        "kept": None, "kept_nested": "nested",
    }


def test_ellipse(spark):
    corners = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)]
    df = spark.createDataFrame([(corners,), ([(0.0, 0.0)] * 4,)], "corners array<struct<x:double,y:double>>")
    round_one, flat = [r.ring for r in S.ellipse_polygons(df, segments=16).collect()]
    assert flat is None and len(round_one) == 17 and round_one[0] == round_one[-1]
    assert all(((p.x - 2) / 2) ** 2 + (p.y - 1) ** 2 == pytest.approx(1) for p in round_one)
    with pytest.raises(ValueError):
        ellipse_ring(F.col("corners"), 7)


def test_each_ellipse_is_worked_out_once(spark, tmp_path):
    from tesserae.bindings.geometry import ellipse_to_polygon

    rows = [(k, k % 3, float(k)) for k in range(20)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    vertices = ellipse_to_polygon(spark, str(tmp_path))
    plan = vertices._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(") == 2 and "COS(" not in plan and "Repartition" in plan
    got = {(r.instance_id, r.vertex): (r.x, r.y) for r in vertices.collect()}
    angle = lambda j: j % 64 * 2 * math.pi / 64
    want = {(k, j): (a + 10 * math.cos(angle(j)), n + (n + 1) * math.sin(angle(j))) for k, n, a in rows for j in range(65)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_paths(spark):
    shell, hole = box(0, 0, 9, 9), box(1, 1, 2, 2)
    cases = [
        (shell, 1, None), (shell[:-1], 1, None), (shell + hole + shell[:1], 2, None),
        (shell + hole + shell[:1] + box(4, 4, 5, 5) + shell[:1], 3, None),
        (shell + hole, None, "missing_separator"), (shell + hole[:-1] + shell[:1], None, "hole_not_closed"),
        (shell + hole[:2] + shell[:1], None, "hole_too_short"), ([(0, 0), (1, 1), (0, 0), (2, 2), (0, 0)], None, "shell_too_short"),
        (shell[:2], None, "too_few_vertices"), ([], None, "too_few_vertices"), ([(0, 0), (1, float("inf")), (2, 2)], None, "not_finite"),
    ]
    df = spark.createDataFrame([(i, [tuple(map(float, p)) for p in path]) for i, (path, _, _) in enumerate(cases)], "i long, path array<struct<x:double,y:double>>")
    for row in S.rings_from_paths(df).collect():
        _, n, problem = cases[row.i]
        assert (None if row.rings is None else len(row.rings)) == n and row.path_problem == problem


def test_circles(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, 2.0, -1.0), (0.0, 0.0, float("nan"))], "x double, y double, radius double")
    rows = S.circle_boxes(df).collect()
    assert tuple(rows[0])[3:] == (-2.0, -1.0, 4.0, 5.0, 6.0) and rows[1].min_x is None and rows[2].diameter is None
    assert not S.circles_qualify(df).first()[0] and S.circles_qualify(df.limit(1)).first()[0] and not S.circles_qualify(df.limit(0)).first()[0]


def ids(spark, values, kind="string"):
    return spark.createDataFrame(list(enumerate(values)), f"row_pos long, instance_id {kind}")


def test_generated_ids(spark):
    rows = ids(spark, ["cell_1", None, "__annotation_4", "__annotation_4", "", "__annotation_x"])
    got = [r.instance_id for r in S.generate_ids(rows).orderBy("row_pos").collect()]
    assert got == ["cell_1", "__annotation_5", "__annotation_4", "__annotation_6", "__annotation_7", "__annotation_x"]
    used = spark.createDataFrame([("__annotation_40",)], "instance_id string")
    assert S.generate_ids(rows, used=used).where("row_pos = 1").first().instance_id == "__annotation_41"
    assert [r.instance_id for r in S.generate_ids(ids(spark, [None, None])).orderBy("row_pos").collect()] == ["__annotation_0", "__annotation_1"]


def test_duplicates_that_are_errors(spark):
    rows = S.dedupe_generated_ids(ids(spark, ["a", "a", "__annotation_1", "__annotation_1"])).orderBy("row_pos").collect()
    assert [r.duplicate for r in rows] == [False, True, False, False] and rows[3].instance_id is None


def test_integer_ids(spark):
    rows = ids(spark, [3, None, 7, None], "long")
    assert [r.instance_id for r in S.generate_integer_ids(rows).orderBy("row_pos").collect()] == [3, 8, 7, 9]
    used = spark.createDataFrame([(20,)], "instance_id long")
    assert [r.instance_id for r in S.generate_integer_ids(rows, used=used).orderBy("row_pos").collect()] == [3, 21, 7, 22]


def test_one_copied_id_over_many_rows_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(scale, "ROWS_PER_RANGE", 25)
    rows = ids(spark, ["__annotation_2"] * 300)
    got = [r.instance_id for r in S.generate_ids(rows.repartition(4)).orderBy("row_pos").collect()]
    assert got == ["__annotation_2"] + [f"__annotation_{i}" for i in range(3, 302)]


@pytest.mark.parametrize("vertices", [7, 300, 7400])
def test_containment_in_a_polygon_with_many_vertices(spark, vertices):
    rng = random.Random(vertices)
    ring = []
    for i in range(vertices):
        angle, radius = 2 * math.pi * i / vertices, rng.uniform(5, 100)
        ring.append((radius * math.cos(angle), radius * math.sin(angle)))
    ring.append(ring[0])
    spots = [(rng.uniform(-110, 110), rng.uniform(-110, 110)) for _ in range(400)] + ring[: min(50, vertices)]

    def inside(x, y):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    want = {i for i, (x, y) in enumerate(spots) if i >= 400 or inside(x, y)}
    shape = spark.createDataFrame([(1, [[{"x": x, "y": y} for x, y in ring]])], "polygon_id long, rings array<array<struct<x:double,y:double>>>")
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(spots)], "id long, x double, y double")
    assert {r.id for r in G.points_in_polygons(df, shape, ["id"]).collect()} == want
