"""Numeric columns: finiteness, clipping, normalisation and affine maps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")

# The tolerances used when two transforms are compared.
RELATIVE_TOLERANCE = 1e-5
ABSOLUTE_TOLERANCE = 1e-8


def is_finite(value: Column) -> Column:
    """False for null, NaN and both infinities."""
    number = value.cast("double")
    return F.coalesce(~F.isnan(number) & (F.abs(number) < F.lit(INFINITY)), F.lit(False))


def finite_or_null(value: Column) -> Column:
    """NaN sorts above every number in Spark, so it must become null before min or max."""
    return F.when(is_finite(value), value.cast("double"))


def all_finite(values: Column) -> Column:
    return F.coalesce(F.forall(values, is_finite), F.lit(False))


def clip(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def unit_position(value: Column, low: Column, high: Column) -> Column:
    """Position in [0, 1]; a constant range maps to the middle; not finite gives null."""
    width = high - low
    scaled = clip((value - low) / F.nullif(width, F.lit(0.0)), F.lit(0.0), F.lit(1.0))
    return F.when(is_finite(value), F.when(width == 0, F.lit(0.5)).otherwise(scaled))


def close(left: Column, right: Column | float) -> Column:
    right = F.lit(float(right)) if isinstance(right, (int, float)) else right
    return F.abs(left - right) <= F.lit(ABSOLUTE_TOLERANCE) + F.lit(RELATIVE_TOLERANCE) * F.abs(right)


@dataclass(frozen=True)
class Affine:
    """Plane map `x' = a x + b y + xoff`, `y' = d x + e y + yoff`."""

    a: float = 1.0
    b: float = 0.0
    d: float = 0.0
    e: float = 1.0
    xoff: float = 0.0
    yoff: float = 0.0

    def after(self, first: "Affine") -> "Affine":
        """The map that applies `first`, then this one."""
        return Affine(
            self.a * first.a + self.b * first.d,
            self.a * first.b + self.b * first.e,
            self.d * first.a + self.e * first.d,
            self.d * first.b + self.e * first.e,
            self.a * first.xoff + self.b * first.yoff + self.xoff,
            self.d * first.xoff + self.e * first.yoff + self.yoff,
        )

    def inverse(self) -> "Affine":
        det = self.a * self.e - self.b * self.d
        if det == 0:
            raise ValueError("The transform has no inverse.")
        a, b, d, e = self.e / det, -self.b / det, -self.d / det, self.a / det
        return Affine(a, b, d, e, -(a * self.xoff + b * self.yoff), -(d * self.xoff + e * self.yoff))

    def x(self, x: Column, y: Column) -> Column:
        return F.lit(self.a) * x + F.lit(self.b) * y + F.lit(self.xoff)

    def y(self, x: Column, y: Column) -> Column:
        return F.lit(self.d) * x + F.lit(self.e) * y + F.lit(self.yoff)


def is_translation(a: Column, b: Column, d: Column, e: Column, zoff: Column | None = None) -> Column:
    """Linear part close to the identity and no shift along z."""
    flat = close(a, 1.0) & close(b, 0.0) & close(d, 0.0) & close(e, 1.0)
    if zoff is not None:
        flat = flat & close(F.coalesce(zoff, F.lit(0.0)), 0.0)
    return F.coalesce(flat, F.lit(False))
