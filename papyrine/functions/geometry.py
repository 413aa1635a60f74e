"""Boxes (struct or columns x0, y0, x1, y1) as Column functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """Four columns; the methods give columns or boxes."""

    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @staticmethod
    def of(prefix: str = "") -> Box:
        return Box(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))

    @staticmethod
    def from_corners(a0: Column, b0: Column, a1: Column, b1: Column) -> Box:
        """GEO-03: with minima and maxima in their places."""
        return Box(F.least(a0, a1), F.least(b0, b1), F.greatest(a0, a1), F.greatest(b0, b1))

    @staticmethod
    def around(points: Column) -> Box:
        """GEO-06: of an array of [x, y]."""
        xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
        return Box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))

    def width(self) -> Column:
        return F.greatest(F.lit(0.0), self.x1 - self.x0)

    def height(self) -> Column:
        return F.greatest(F.lit(0.0), self.y1 - self.y0)

    def area(self) -> Column:
        return self.width() * self.height()

    def cx(self) -> Column:
        return (self.x0 + self.x1) / 2

    def cy(self) -> Column:
        return (self.y0 + self.y1) / 2

    def contains(self, x: Column, y: Column) -> Column:
        return x.between(self.x0, self.x1) & y.between(self.y0, self.y1)

    def scaled(self, sx: float, sy: float) -> Box:
        return Box(self.x0 * sx, self.y0 * sy, self.x1 * sx, self.y1 * sy)

    def union(self, other: Box) -> Box:
        return Box(F.least(self.x0, other.x0), F.least(self.y0, other.y0), F.greatest(self.x1, other.x1), F.greatest(self.y1, other.y1))

    def common_area(self, other: Box) -> Column:
        """GEO-02."""
        w = F.greatest(F.lit(0.0), F.least(self.x1, other.x1) - F.greatest(self.x0, other.x0))
        return w * F.greatest(F.lit(0.0), F.least(self.y1, other.y1) - F.greatest(self.y0, other.y0))

    def iou(self, other: Box) -> Column:
        both = self.area() + other.area() - self.common_area(other)
        return F.when(both > 0, self.common_area(other) / both).otherwise(0.0)

    def coverage_by(self, other: Box) -> Column:
        return F.when(self.area() > 0, self.common_area(other) / self.area()).otherwise(0.0)

    def mapped(self, m: tuple[float, ...]) -> Box:
        """GEO-04: the box around the corners under x' = a x + c y + e, y' = b x + d y + f."""
        a, b, c, d, e, f = m
        xs = [a * x + c * y + e for x in (self.x0, self.x1) for y in (self.y0, self.y1)]
        ys = [b * x + d * y + f for x in (self.x0, self.x1) for y in (self.y0, self.y1)]
        return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))

    def padded(self, pad: float, width: float, height: float) -> Box:
        """GEO-05: with a margin, inside the page, to whole pixels; callers drop empty ones."""
        low = lambda c: F.floor(F.greatest(F.lit(0.0), c - pad))
        return Box(low(self.x0), low(self.y0), F.ceil(F.least(F.lit(float(width)), self.x1 + pad)), F.ceil(F.least(F.lit(float(height)), self.y1 + pad)))

    def rounded(self, digits: int = 2) -> Box:
        return Box(*(F.round(c, digits) for c in (self.x0, self.y0, self.x1, self.y1)))

    def near(self, other: Box, gap: float = 36.0) -> Column:
        """JN-05: overlapping in x and at most gap apart in y."""
        apart = F.least(F.abs(self.y0 - other.y1), F.abs(other.y0 - self.y1))
        return (F.least(self.x1, other.x1) > F.greatest(self.x0, other.x0)) & (apart <= gap)

    def struct(self) -> Column:
        return F.struct(self.x0.alias("x0"), self.y0.alias("y0"), self.x1.alias("x1"), self.y1.alias("y1"))


def inverse(m: tuple[float, ...]) -> tuple[float, ...]:
    a, b, c, d, e, f = m
    det = a * d - b * c
    return d / det, -b / det, -c / det, a / det, (c * f - d * e) / det, (b * e - a * f) / det


def resize_factor(long_side: Column, least: int = 1200, most: int = 4000) -> Column:
    """IMG-01: the scale that brings the long side between the bounds."""
    return F.when(long_side < least, least / long_side).when(long_side > most, most / long_side).otherwise(1.0)
