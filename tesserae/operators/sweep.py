"""Whether the rings of a polygon meet, and how they lie to each other, by a plane sweep over each polygon.

A line moves over the edges from left to right and keeps the edges that it meets in their order from bottom to top. Only edges
that are next to each other in that order can be the first to meet, so n edges take about n log n comparisons, however long
and close to each other they are. All comparisons are exact. Where an edge runs through a vertex it is cut there, so that rings
may touch in points without upsetting the order.
"""

from __future__ import annotations

from collections import Counter
from fractions import Fraction

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.orientation import ROUNDING

Point = tuple[float, float]


def side(a: Point, b: Point, p: Point) -> int:
    """1 if p is left of the line from a to b, -1 if right of it, 0 if on it."""
    left, right = (b[0] - a[0]) * (p[1] - a[1]), (b[1] - a[1]) * (p[0] - a[0])
    bound = (abs(left) + abs(right)) * ROUNDING
    if left - right > bound:
        return 1
    if right - left > bound:
        return -1
    (ax, ay), (bx, by), (px, py) = (tuple(map(Fraction, v)) for v in (a, b, p))
    exact = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    return (exact > 0) - (exact < 0)


class _Edge:
    __slots__ = ("left", "right", "ring", "number")

    def __init__(self, left: Point, right: Point, ring: int, number: int) -> None:
        self.left, self.right, self.ring, self.number = left, right, ring, number


def _crossing(a: _Edge, b: _Edge) -> bool:
    """Whether two edges cross in inner points of both."""
    return (
        side(a.left, a.right, b.left) * side(a.left, a.right, b.right) < 0
        and side(b.left, b.right, a.left) * side(b.left, b.right, a.right) < 0
    )


def _conflict(a: _Edge, b: _Edge) -> str:
    return "self_intersection" if a.ring == b.ring else "ring_crossing"


def _pairs_cross(around: list[int]) -> bool:
    """Whether rings cross at a common vertex. Each has two ends there; listed in turn, those of rings that only touch nest."""
    open_: list[int] = []
    for ring in around:
        if open_ and open_[-1] == ring:
            open_.pop()
        else:
            open_.append(ring)
    return bool(open_)


def first_conflict(rings: list[list[Point]]) -> str | None:
    """What the sweep finds: `self_intersection` if edges of one ring meet that are not neighbours at their common vertex, or run
    back along each other; `ring_crossing` if rings cross or run along each other. Else `hole_outside` if a ring after the
    first is not inside the first, or `nested_holes` if it is inside another one after the first."""
    events: dict[Point, list[_Edge]] = {}
    sizes = []
    for r, ring in enumerate(rings):
        edges = [(p, q) for p, q in zip(ring[:-1], ring[1:]) if p != q]
        sizes.append(len(edges))
        for k, (p, q) in enumerate(edges):
            edge = _Edge(min(p, q), max(p, q), r, k)
            events.setdefault(edge.left, []).append(edge)
            events.setdefault(edge.right, [])
    active: list[_Edge] = []  # from bottom to top
    seen, outside, nested = set(), False, False
    for p in sorted(events):
        low, high = 0, len(active)
        while low < high:  # the first edge that is not below p
            middle = (low + high) // 2
            edge = active[middle]
            if edge.right != p and side(edge.left, edge.right, p) > 0:
                low = middle + 1
            else:
                high = middle
        end = low
        while end < len(active) and (active[end].right == p or side(active[end].left, active[end].right, p) == 0):
            end += 1
        here, starts = active[low:end], events[p]
        through = [e for e in here if e.right != p]
        meeting: dict[int, list[_Edge]] = {}
        for e in [*here, *starts]:
            meeting.setdefault(e.ring, []).append(e)
        for ring, edges in meeting.items():
            if len(edges) > 2 or len(edges) == 2 and (
                edges[0] in through or edges[1] in through or abs(edges[0].number - edges[1].number) not in (1, sizes[ring] - 1)
            ):
                return "self_intersection"
        # what goes on to the right of p, from bottom to top; an edge that runs through p is cut there
        ordered: list[_Edge] = []
        for e in [*starts, *(_Edge(p, e.right, e.ring, e.number) for e in through)]:
            at = 0
            while at < len(ordered):
                turn = side(p, ordered[at].right, e.right)
                if turn == 0:
                    return _conflict(e, ordered[at])
                if turn < 0:
                    break
                at += 1
            ordered.insert(at, e)
        active[low:end] = ordered
        if len(meeting) > 1 and _pairs_cross([e.ring for e in ordered] + [e.ring for e in reversed(here)]):
            return "ring_crossing"
        for ring in meeting.keys() - seen if len(rings) > 1 else ():
            seen.add(ring)
            if ring:
                below = Counter(e.ring for e in active[: next(i for i, e in enumerate(active) if e.ring == ring)])
                outside |= below[0] % 2 == 0
                nested |= any(n % 2 for r, n in below.items() if r)
        last = low + len(ordered)
        for a, b in ((low - 1, low), (last - 1, last)):
            if a >= 0 and b < len(active) and _crossing(active[a], active[b]):
                return _conflict(active[a], active[b])
    return "hole_outside" if outside else "nested_holes" if nested else None


def rings_problem(rings: list[list[Point]]) -> str | None:
    """`self_intersection` if any ring meets itself, else what is wrong between the rings."""
    for ring in rings:
        if found := first_conflict([ring]):
            return found
    return first_conflict(rings) if len(rings) > 1 else None


@F.arrow_udf(returnType=T.StringType())
def ring_problems(polygons: pa.Array) -> pa.Array:
    """What is wrong with the rings of each polygon (null for none): they must be closed and finite. Null polygons give null."""
    rings = polygons.flatten()
    points = rings.flatten()
    xy = list(zip(points.field("x").to_pylist(), points.field("y").to_pylist()))
    ring_ends, ends = _ends(rings), _ends(polygons)
    found = (rings_problem([xy[a:b] for a, b in zip(ring_ends[i : j], ring_ends[i + 1 : j + 1])]) for i, j in zip(ends[:-1], ends[1:]))
    return pa.array(found, pa.string())


def _ends(lists: pa.ListArray) -> list[int]:
    """Where each list ends in the flattened values, after a zero."""
    return [0, *pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0)).to_pylist()]
