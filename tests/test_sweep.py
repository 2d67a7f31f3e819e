"""The plane sweep against all pairs of edges, and orientation against rational numbers."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions.orientation import orientation
from tesserae.operators import sweep as S
from tesserae.operators.spatial import validate_polygons


def exact(a, b, p):
    (ax, ay), (bx, by), (px, py) = (tuple(map(Fraction, v)) for v in (a, b, p))
    value = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    return (value > 0) - (value < 0)


def inside(ring, p):
    """1 inside, 0 on the rim, -1 outside."""
    odd = False
    for a, b in zip(ring[:-1], ring[1:]):
        turn = exact(a, b, p)
        if turn == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1]):
            return 0
        if (a[1] > p[1]) != (b[1] > p[1]) and (turn > 0) == (b[1] > a[1]):
            odd = not odd
    return 1 if odd else -1


def plain(rings):
    edges = []
    for r, ring in enumerate(rings):
        own = [(p, q) for p, q in zip(ring[:-1], ring[1:]) if p != q]
        edges += [(p, q, r, k, len(own)) for k, (p, q) in enumerate(own)]
    bad = set()
    for i, (a, b, r, k, n) in enumerate(edges):
        for c, d, s, l, _ in edges[i + 1 :]:
            turns = exact(c, d, a), exact(c, d, b), exact(a, b, c), exact(a, b, d)
            if turns[0] * turns[1] > 0 or turns[2] * turns[3] > 0:
                continue
            span = [min(max(a[i], b[i]), max(c[i], d[i])) - max(min(a[i], b[i]), min(c[i], d[i])) for i in (0, 1)]
            if min(span) < 0:
                continue
            overlap = not any(turns) and max(span) > 0
            cross = turns[0] * turns[1] < 0 and turns[2] * turns[3] < 0
            if r == s and (overlap or abs(k - l) not in (1, n - 1)):
                bad.add("self_intersection")
            elif r != s and (overlap or cross):
                bad.add("ring_crossing")
    for kind in ("self_intersection", "ring_crossing"):
        if kind in bad:
            return kind
    # a ring lies on one side of another one, unless they cross at vertices
    def where(ring, other):
        probes = []  # a point within each piece between the points that the other ring has on the edge
        for a, b in ((p, q) for p, q in zip(ring[:-1], ring[1:]) if p != q):
            on = sorted({Fraction(0), Fraction(1)} | {at for v in other if exact(a, b, v) == 0 for at in [position(a, b, v)] if 0 < at < 1})
            for s, t in zip(on[:-1], on[1:]):
                m = (s + t) / 2
                probes.append((a[0] + m * (Fraction(b[0]) - Fraction(a[0])), a[1] + m * (Fraction(b[1]) - Fraction(a[1]))))
        return {inside(other, p) for p in probes}

    sides = {(i, j): where(rings[i], rings[j]) for i in range(len(rings)) for j in range(len(rings)) if i != j}
    if any(len(s) > 1 for s in sides.values()):
        return "ring_crossing"
    if any(sides[i, 0] == {-1} for i in range(1, len(rings))):
        return "hole_outside"
    if any(sides[i, j] == {1} for i in range(1, len(rings)) for j in range(1, len(rings)) if i != j):
        return "nested_holes"
    return None


def position(a, b, v):
    k = 0 if a[0] != b[0] else 1
    return (Fraction(v[k]) - Fraction(a[k])) / (Fraction(b[k]) - Fraction(a[k]))


def random_rings(rng, grid):
    rings = []
    for r in range(rng.choice([1, 1, 2, 2, 3])):
        if rng.random() < 0.5:  # a box, so that rings often lie in each other or touch
            x, y = rng.randrange(grid), rng.randrange(grid)
            w, h = rng.randrange(1, grid + 1), rng.randrange(1, grid + 1)
            ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)] if r or rng.random() < 0.5 else [(0, 0), (2 * grid, 0), (2 * grid, 2 * grid), (0, 2 * grid)]
        else:
            ring = [(rng.randrange(grid), rng.randrange(grid)) for _ in range(rng.choice([3, 3, 4, 5, 7]))]
            if rng.random() < 0.7:
                cx, cy = (sum(p[i] for p in ring) / len(ring) + 0.01 for i in (0, 1))
                ring.sort(key=lambda p: math.atan2(p[1] - cy, p[0] - cx))
        ring = [(float(x), float(y)) for x, y in [*ring, ring[0]]]
        if len(set(ring)) < 3 or not any(exact(ring[0], ring[1], p) for p in ring) and not any(exact(ring[1], ring[2], p) for p in ring):
            return None
        rings.append(ring)
    return rings


@pytest.mark.parametrize("grid", [3, 4, 6, 12])
def test_sweep_agrees_with_all_pairs(grid):
    rng, seen = random.Random(grid), {}
    for _ in range(1500):
        rings = random_rings(rng, grid)
        if rings:
            want = plain(rings)
            seen[want] = seen.get(want, 0) + 1
            assert S.rings_problem(rings) == want, rings
    assert len(seen) >= 4


def test_long_edges_side_by_side_take_few_comparisons(monkeypatch):
    """All boxes of these edges overlap each other, but an edge is compared with its neighbours alone."""
    count, side = [0], S.side
    monkeypatch.setattr(S, "side", lambda *a: count.__setitem__(0, count[0] + 1) or side(*a))
    found = []
    for m in (200, 2_000):
        comb = []
        for i in range(m):
            tooth = [(float(i), -float(i)), (i + 5000.0, 5000.0 - i)]
            comb += tooth if i % 2 == 0 else tooth[::-1]
        ring = [*comb, (m + 9000.0, -float(m)), (float(m), -m - 9000.0), (-9000.0, -9000.0)]
        count[0] = 0
        assert S.rings_problem([[*ring, ring[0]]]) is None
        found.append(count[0] / (len(ring) * math.log2(len(ring))))
    assert max(found) < 4 and found[1] < 1.5 * found[0]


def test_near_collinear_triples(spark):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(3000):
        a, d = rng.random(2) * 10.0 ** rng.integers(-6, 7), rng.random(2) * 10.0 ** rng.integers(-6, 7)
        b, p = a + d, a + d * rng.random()
        p = np.nextafter(p, p + rng.integers(-1, 2, 2)) if rng.random() < 0.7 else p
        rows.append((*a, *b, *p))
    rows += [(0.1 * i, 0.1 * i, 0.3 * i, 0.3 * i, 0.7 * i, 0.7 * i) for i in range(1, 60)]  # equal coordinates: on the line
    rows = [tuple(map(float, r)) for r in rows]
    df = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double, x double, y double")
    edge = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    got = df.select("*", orientation(edge, F.col("x"), F.col("y")).alias("turn")).collect()
    want = {r: exact(r[:2], r[2:4], r[4:]) for r in rows}
    assert {tuple(r)[:6]: r.turn for r in got} == want
    rounded = [np.sign((c - a) * (f - b) - (d - b) * (e - a)) for a, b, c, d, e, f in rows]
    assert sum(w != r for w, r in zip(want.values(), rounded)) > 100  # doubles alone get many of them wrong
    assert all(S.side(r[:2], r[2:4], r[4:]) == w for r, w in want.items())


def test_polygons_are_judged_in_their_rows(spark):
    shell = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    hole = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    cases = {
        "valid": ([shell, hole(1.0, 1.0, 2.0), hole(3.0, 3.0, 2.0)], None), "outside": ([shell, hole(20.0, 1.0, 2.0)], "hole_outside"),
        "nested": ([shell, hole(1.0, 1.0, 5.0), hole(2.0, 2.0, 1.0)], "nested_holes"), "crossing": ([shell, hole(9.0, 9.0, 5.0)], "ring_crossing"),
        "corners": ([shell, [(5.0, 10.0), (4.0, 9.0), (5.0, 12.0), (6.0, 9.0), (5.0, 10.0)]], "ring_crossing"), "open": ([shell[:-1]], "not_closed"),
        "empty": ([], "empty"), "null": (None, "empty"), "nan": ([[(0.0, math.nan), *shell[1:4], (0.0, math.nan)]], "not_finite"),
        "through a vertex": ([shell, [(10.0, 10.0), (8.0, 12.0), (8.0, 8.0), (12.0, 8.0), (10.0, 10.0)]], "ring_crossing"),
        "twice": ([[*shell[:2], shell[1], *shell[2:]]], None), "rim": ([shell, hole(0.0, 0.0, 5.0)], "ring_crossing"),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "polygon_id string, rings array<array<struct<x:double,y:double>>>")
    found = validate_polygons(df.repartition(3))
    assert {r.polygon_id: r.problem for r in found.collect()} == {k: v[1] for k, v in cases.items()}
