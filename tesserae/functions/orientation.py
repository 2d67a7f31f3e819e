"""The side of a line on which a point lies, exactly.

The determinant is first taken in doubles. If it is larger than all rounding can have made it, its sign is right. Else the
six products of the determinant are written as sums of two doubles each, and the twelve parts are added without
rounding: a sum is kept as a list of doubles that do not overlap, so its largest member has the sign of the whole. Only
points within about 1e-15 of the line, relative to the size of the products, take the second way.

Exact as long as no product overflows or falls below 1e-290.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# rounding of the determinant, relative to the sum of the two products: (3 + 16 u) u with u = 2**-53
ROUNDING = (3 + 16 * 2.0**-53) * 2.0**-53
SPLITTER = 2.0**27 + 1


def _high(v: str) -> str:
    """The upper half of a double's digits."""
    return f"({v} * {SPLITTER!r}D - ({v} * {SPLITTER!r}D - {v}))"


def _exact_text() -> str:
    """A function of (x1, y1, x2, y2, x, y), as SQL text: it is long, and so is parsed instead of being put together anew for each use."""
    products = [("t.x2", "t.y"), ("-t.x2", "t.y1"), ("-t.x1", "t.y"), ("-t.y2", "t.x"), ("t.y2", "t.x1"), ("t.y1", "t.x")]
    factors = ", ".join(f"struct({a} AS a, {b} AS b)" for a, b in products)
    ah, bh = _high("p.a"), _high("p.b")
    al, bl = f"(p.a - {ah})", f"(p.b - {bh})"
    # a product as its double and what rounding took away
    parts = f"p -> array(p.a * p.b, {al} * {bl} - (((p.a * p.b - {ah} * {bh}) - {al} * {bh}) - {ah} * {bl}))"
    total = "(s.sum + w)"
    lost = f"(s.sum - ({total} - ({total} - s.sum))) + (w - ({total} - s.sum))"
    none = "CAST(array() AS ARRAY<DOUBLE>)"
    # a list of doubles that do not overlap, with one more double added
    add = f"""(e, v) -> aggregate(e, struct(v AS sum, {none} AS done), (s, w) -> struct({total} AS sum, concat(s.done, array({lost})) AS done),
      s -> concat(s.done, array(s.sum)))"""
    sign = "(g, v) -> CASE WHEN v > 0 THEN 1 WHEN v < 0 THEN -1 ELSE g END"
    return f"t -> aggregate(aggregate(flatten(transform(array({factors}), {parts})), {none}, {add}), 0, {sign})"


EXACT = _exact_text()


def orientation(s: Column, x: Column, y: Column) -> Column:
    """1 if (x, y) is left of the edge `s(x1, y1, x2, y2)`, -1 if it is right of it, 0 if it is on its line."""
    left = (s["x2"] - s["x1"]) * (y - s["y1"])
    right = (s["y2"] - s["y1"]) * (x - s["x1"])
    bound = (F.abs(left) + F.abs(right)) * ROUNDING
    level = ((s["x2"] == s["x1"]) | (y == s["y1"])) & ((s["y2"] == s["y1"]) | (x == s["x1"]))
    six = F.struct(*(s[c].alias(c) for c in ("x1", "y1", "x2", "y2")), x.cast("double").alias("x"), y.cast("double").alias("y"))
    exact = F.get(F.call_function("transform", F.array(six), F.expr(EXACT)), F.lit(0))
    return F.when(left - right > bound, 1).when(right - left > bound, -1).when(level, 0).otherwise(exact)
