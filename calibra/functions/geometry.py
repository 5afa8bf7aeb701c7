"""Rectangles (x0, y0, x1, y1), quadrilaterals and points as column expressions. y grows downwards."""

from __future__ import annotations

from math import hypot
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


class Rect(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, table: str = "") -> Rect:
        dot = f"{table}." if table else ""
        return cls(*(F.col(f"{dot}{c}") for c in cls._fields))

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def area(self) -> Column:
        return F.greatest(self.width, F.lit(0.0)) * F.greatest(self.height, F.lit(0.0))

    @property
    def longer(self) -> Column:
        return F.greatest(self.width, self.height)

    @property
    def shorter(self) -> Column:
        return F.least(self.width, self.height)

    def grown(self, by: Column | float) -> Rect:
        return Rect(self.x0 - by, self.y0 - by, self.x1 + by, self.y1 + by)

    def holds(self, x: Column, y: Column) -> Column:
        return (x >= self.x0) & (x <= self.x1) & (y >= self.y0) & (y <= self.y1)


def shared_area(a: Rect, b: Rect) -> Column:
    zero = F.lit(0.0)
    return F.greatest(F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), zero) * F.greatest(F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0), zero)


def meet(a: Rect, b: Rect) -> Column:
    """Whether the rectangles share an area; those that only touch don't."""
    return (F.least(a.x1, b.x1) > F.greatest(a.x0, b.x0)) & (F.least(a.y1, b.y1) > F.greatest(a.y0, b.y0))


def share_of_smaller(a: Rect, b: Rect) -> Column:
    """The shared area as a share of the smaller rectangle's; 0 if that is empty."""
    least = F.least(a.area, b.area)
    return F.when(least > 0, shared_area(a, b) / least).otherwise(0.0)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def centre_distance(a: Rect, b: Rect) -> Column:
    return distance((a.x0 + a.x1) / 2, (a.y0 + a.y1) / 2, (b.x0 + b.x1) / 2, (b.y0 + b.y1) / 2)


def point_distance(x: Column, y: Column, r: Rect) -> Column:
    """Distance of a point to a rectangle; 0 within."""
    zero = F.lit(0.0)
    dx, dy = F.greatest(r.x0 - x, x - r.x1, zero), F.greatest(r.y0 - y, y - r.y1, zero)
    return F.sqrt(dx * dx + dy * dy)


def axis_bounds(quad: Column, ax: Column, ay: Column) -> tuple[Column, Column]:
    """Least and greatest projection of a quadrilateral's points (structs x, y) on a direction."""
    along = F.transform(quad, lambda p: p.x * ax + p.y * ay)
    return F.array_min(along), F.array_max(along)


def gap(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Space between two intervals; 0 if they meet."""
    return F.greatest(F.greatest(a[0], b[0]) - F.least(a[1], b[1]), F.lit(0.0))


def direction(quad: Column) -> Column:
    """struct(dx, dy): unit vector from the first point to the second; a length of 0 divides by 1."""
    p, q = F.get(quad, F.lit(0)), F.get(quad, F.lit(1))
    dx, dy = q.x - p.x, q.y - p.y
    n = F.sqrt(dx * dx + dy * dy)
    n = F.when(n == 0, 1.0).otherwise(n)
    return F.struct((dx / n).alias("dx"), (dy / n).alias("dy"))


def bounds(quad: Column) -> Column:
    """struct(x0, y0, x1, y1) around a quadrilateral."""
    xs, ys = F.transform(quad, lambda p: p.x), F.transform(quad, lambda p: p.y)
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def snapped(dx: Column, dy: Column, limit: float = 0.965) -> Column:
    """struct(dx, dy) with a direction near an axis put on it."""
    return F.when(F.abs(dx) >= limit, F.struct(F.signum(dx).alias("dx"), F.lit(0.0).alias("dy"))).when(F.abs(dy) >= limit, F.struct(F.lit(0.0).alias("dx"), F.signum(dy).alias("dy"))).otherwise(F.struct(dx.alias("dx"), dy.alias("dy")))


def columnar(r: Rect, dy: Column) -> Column:
    """Whether a line of text runs down the page."""
    return (F.abs(dy) >= 0.72) | (r.height / F.greatest(r.width, F.lit(1e-6)) >= 1.6)


def rotated(x: Column, y: Column, degrees: float, width: Column, height: Column) -> tuple[Column, Column]:
    """A point found in a page turned by 90 or 270 degrees, on the page as it was."""
    if degrees == 90:
        return y, height - x
    if degrees == 270:
        return width - y, x
    return x, y


def polygon_area(points: Column) -> Column:
    """Area of a polygon, an array of structs x, y."""
    turned = F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    return F.abs(F.aggregate(F.zip_with(points, turned, lambda p, q: p.x * q.y - q.x * p.y), F.lit(0.0), lambda s, v: s + v)) / 2


def in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Even-odd rule over a polygon's edges."""
    turned = F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    crossed = F.zip_with(points, turned, lambda p, q: ((p.y > y) != (q.y > y)) & (x < (q.x - p.x) * (y - p.y) / F.when(q.y == p.y, 1e-12).otherwise(q.y - p.y) + p.x))
    return F.size(F.filter(crossed, lambda c: c)) % 2 == 1


def point_segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    length = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.when(length > 0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / length).otherwise(0.0)
    t = F.greatest(F.least(t, F.lit(1.0)), F.lit(0.0))
    return distance(x, y, ax + t * (bx - ax), ay + t * (by - ay))


def _struct(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def quad_of(along: tuple[Column, Column], across: tuple[Column, Column], dx: Column, dy: Column) -> Column:
    """The quadrilateral of two intervals, along a direction and across it."""
    at = lambda a, c: _struct(a * dx - c * dy, a * dy + c * dx)
    return F.array(at(along[0], across[0]), at(along[1], across[0]), at(along[1], across[1]), at(along[0], across[1]))


def extended(base: Column, extra: Column, dx: Column, dy: Column, by: float = 0.8) -> Column:
    """base, as long as both quadrilaterals and a bit more, as thick as it was."""
    a, b = axis_bounds(base, dx, dy), axis_bounds(extra, dx, dy)
    return quad_of((F.least(a[0], b[0]) - by, F.greatest(a[1], b[1]) + by), axis_bounds(base, -dy, dx), dx, dy)


def as_thick(points: Column, dx: Column, dy: Column, thickness: Column, by: float = 0.6) -> Column:
    """A strip of the given thickness (2.8 at least) around points, a bit longer than they are."""
    along, across = axis_bounds(points, dx, dy), axis_bounds(points, -dy, dx)
    middle, half = (across[0] + across[1]) / 2, F.greatest(thickness, F.lit(2.8)) / 2
    return quad_of((along[0] - by, along[1] + by), (middle - half, middle + half), dx, dy)


def same_region(a: Column, b: Column) -> Column:
    """Whether two polygons are one: their boxes share 88 % of the smaller, or all points lie within 0.5 of each other."""
    ra, rb = (Rect(*(bounds(p)[c] for c in Rect._fields)) for p in (a, b))
    close = (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda p, q: distance(p.x, p.y, q.x, q.y) < 0.5), lambda ok: ok)
    return (share_of_smaller(ra, rb) >= 0.88) | close


def simplified(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """A line without the points that lie within the tolerance of what is left (Ramer, Douglas, Peucker), without recursion."""
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        lo, hi = todo.pop()
        (ax, ay), (bx, by) = points[lo], points[hi]
        length = hypot(bx - ax, by - ay)
        far, at = 0.0, -1
        for k in range(lo + 1, hi):
            x, y = points[k]
            d = abs((by - ay) * (x - ax) - (bx - ax) * (y - ay)) / length if length else hypot(x - ax, y - ay)
            if d > far:
                far, at = d, k
        if far > tolerance:
            keep.add(at)
            todo += [(lo, at), (at, hi)]
    return [points[k] for k in sorted(keep) if k >= 0]


def simplify(tolerance: float):
    """A function of a column of lines (arrays of structs x, y) that simplifies each; runs in Python, batch by batch."""

    @F.pandas_udf(ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])))
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda line: None if line is None else [{"x": x, "y": y} for x, y in simplified([(p["x"], p["y"]) for p in line], tolerance)] if len(line) else [])

    return run
