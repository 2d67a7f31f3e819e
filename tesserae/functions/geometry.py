"""Polygon columns.

A ring is `array<struct<x,y>>`, closed (first vertex repeated at the end). A polygon is an array of rings, the
shell first and its holes after it. A multi-part shape is an array of polygons.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.numeric import Affine, is_finite
from tesserae.functions.orientation import orientation

# Vertices of a polygon that stands for an ellipse.
ELLIPSE_SEGMENTS = 64
MIN_ELLIPSE_SEGMENTS = 8


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def first(items: Column) -> Column:
    """First element, null for an empty array (`element_at` would fail)."""
    return F.get(items, F.lit(0))


def last(items: Column) -> Column:
    return F.get(items, F.size(items) - 1)


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def close_ring(ring: Column) -> Column:
    """Repeat the first vertex unless the ring already ends on it."""
    return F.when(first(ring) == last(ring), ring).otherwise(
        F.concat(ring, F.slice(ring, 1, 1))
    )


def ring_edges(ring: Column) -> Column:
    """Consecutive vertex pairs of a closed ring."""
    return F.zip_with(
        F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))),
        F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))),
        lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")),
    )


def polygon_edges(rings: Column) -> Column:
    return F.flatten(F.transform(rings, ring_edges))


def signed_area(ring: Column) -> Column:
    """Shoelace formula; counter-clockwise rings are positive."""
    doubled = F.aggregate(
        ring_edges(ring), F.lit(0.0), lambda acc, s: acc + (s["x1"] * s["y2"] - s["x2"] * s["y1"])
    )
    return doubled / 2


def polygon_area(rings: Column) -> Column:
    """Shell area minus hole areas."""
    shell = F.abs(signed_area(first(rings)))
    holes = F.aggregate(
        F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))),
        F.lit(0.0),
        lambda acc, ring: acc + F.abs(signed_area(ring)),
    )
    return shell - holes


def bounds(rings: Column) -> Column:
    shell = first(rings)
    xs, ys = F.transform(shell, lambda p: p["x"]), F.transform(shell, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"),
        F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"),
    )


def transform_rings(rings: Column, affine: Affine) -> Column:
    return F.transform(
        rings,
        lambda ring: F.transform(ring, lambda p: point(affine.x(p["x"], p["y"]), affine.y(p["x"], p["y"]))),
    )


def on_edge(s: Column, x: Column, y: Column) -> Column:
    return (
        (x >= F.least(s["x1"], s["x2"])) & (x <= F.greatest(s["x1"], s["x2"]))
        & (y >= F.least(s["y1"], s["y2"])) & (y <= F.greatest(s["y1"], s["y2"]))
        & (orientation(s, x, y) == 0)
    )


def crosses_ray(s: Column, x: Column, y: Column) -> Column:
    """The edge meets the horizontal ray that starts at the point and runs towards larger x."""
    straddles = (s["y1"] > y) != (s["y2"] > y)
    rising = F.when(s["y2"] > s["y1"], 1).otherwise(-1)
    return straddles & (orientation(s, x, y) * rising > 0)


def on_boundary(edges: Column, x: Column, y: Column) -> Column:
    return F.exists(edges, lambda s: on_edge(s, x, y))


def covers(edges: Column, x: Column, y: Column) -> Column:
    """Boundary counts as in, the inside of a hole as out, the rim of a hole as in."""
    odd = F.aggregate(edges, F.lit(0), lambda n, s: n + crosses_ray(s, x, y).cast("int")) % 2 == 1
    return odd | on_boundary(edges, x, y)


def edges_in_slab(edges: Column, low: Column, high: Column) -> Column:
    """Edges that a horizontal ray starting between `low` and `high` could meet."""
    return F.filter(
        edges, lambda s: (F.greatest(s["y1"], s["y2"]) >= low) & (F.least(s["y1"], s["y2"]) <= high)
    )


def edges_between(edges: Column, low: Column, high: Column) -> Column:
    """Edges whose extent in x touches the interval."""
    return F.filter(edges, lambda s: (F.greatest(s["x1"], s["x2"]) >= low) & (F.least(s["x1"], s["x2"]) <= high))


def crosses_upward(s: Column, x: Column, y: Column) -> Column:
    """The edge meets the vertical ray that starts at the point and runs upward. A point on the edge's line is taken to lie
    to the right of it, as in `crosses_ray`, so that both rays tell the same parity."""
    straddles = (s["x1"] > x) != (s["x2"] > x)
    rising, forward = (F.when(s[f"{c}2"] > s[f"{c}1"], 1).otherwise(-1) for c in ("y", "x"))
    flat, along = s["y1"] == s["y2"], rising == forward
    # left of the edge, taken upward, or below a level one; for an edge that runs up to the right the other side, with the line
    turned = orientation(s, x, y) * F.when(flat, -forward).when(along, -rising).otherwise(rising)
    return straddles & (turned > F.when(~flat & along, -1).otherwise(0))


def odd_at(edges: Column, x: Column, y: Column) -> Column:
    """Whether the ray to the right of the point meets an odd number of edges."""
    return F.aggregate(edges, F.lit(0), lambda n, s: n + crosses_ray(s, x, y).cast("int")) % 2 == 1


def odd_in_cell(edges: Column, base: Column, x: Column, y: Column, ref_x: Column, ref_y: Column) -> Column:
    """The parity of a point from that of its cell's reference point, `base`: the path between them, along y and then along
    x, stays in the cell, so only edges that touch the cell can change it."""
    changes = F.aggregate(
        edges, F.lit(0), lambda n, s: n + (crosses_ray(s, x, y) != crosses_ray(s, ref_x, y)).cast("int")
        + (crosses_upward(s, ref_x, y) != crosses_upward(s, ref_x, ref_y)).cast("int"),
    )
    return base != (changes % 2 == 1)


def ring_problem(ring: Column) -> Column:
    """First failed rule of a ring that must be closed, finite and enclose an area (self-crossing is separate)."""
    distinct = F.size(F.array_distinct(ring))
    return (
        F.when(ring.isNull() | (F.size(ring) == 0), F.lit("empty"))
        .when(~F.forall(ring, lambda p: is_finite(p["x"]) & is_finite(p["y"])), F.lit("not_finite"))
        .when(first(ring) != last(ring), F.lit("not_closed"))
        .when(distinct < 3, F.lit("too_few_vertices"))
        .when(signed_area(ring) == 0, F.lit("no_area"))
    )


def circle_box(x: Column, y: Column, radius: Column) -> Column:
    """Corner points of a circle's bounding box, null unless the radius is positive and finite."""
    ok = is_finite(radius) & (radius > 0)
    return F.when(
        ok,
        F.struct(
            (x - radius).alias("min_x"), (y - radius).alias("min_y"),
            (x + radius).alias("max_x"), (y + radius).alias("max_y"), (radius * 2).alias("diameter"),
        ),
    )


def ellipse_ring(corners: Column, segments: int = ELLIPSE_SEGMENTS) -> Column:
    """Polygon with `segments` vertices for an ellipse given by four box corners; null for a degenerate axis."""
    if segments < MIN_ELLIPSE_SEGMENTS:
        raise ValueError(f"An ellipse needs at least {MIN_ELLIPSE_SEGMENTS} segments.")
    c = [F.get(corners, F.lit(i)) for i in range(4)]

    def axis(end: Column, name: str) -> Column:
        return (end[name] - c[0][name]) / 2

    def center(name: str) -> Column:
        return (c[0][name] + c[1][name] + c[2][name] + c[3][name]) / 4

    ax, ay, bx, by = axis(c[1], "x"), axis(c[1], "y"), axis(c[3], "x"), axis(c[3], "y")
    frame = F.struct(*[v.alias(n) for n, v in (("cx", center("x")), ("cy", center("y")), ("ax", ax), ("ay", ay), ("bx", bx), ("by", by))])
    angles = [i % segments * (2 * math.pi / segments) for i in range(segments + 1)]
    units = F.array(*[F.struct(F.cos(F.lit(t)).alias("cos"), F.sin(F.lit(t)).alias("sin")) for t in angles])  # folded into a literal
    # the frame is bound to a variable: otherwise it is worked out from the corners again for each vertex
    ring = F.get(F.transform(F.array(frame), lambda f: F.transform(units, lambda u: point(
        f["cx"] + u["cos"] * f["ax"] + u["sin"] * f["bx"], f["cy"] + u["cos"] * f["ay"] + u["sin"] * f["by"]))), F.lit(0))
    la, lb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
    usable = is_finite(la) & (la > 0) & is_finite(lb) & (lb > 0) & (F.size(corners) == 4)
    return F.when(usable, ring)
