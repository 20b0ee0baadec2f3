"""Geometry as column arithmetic, so that it stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M_PER_DEGREE = 111_320.0
EARTH_M = 6_371_000.0


def projected(h: list[Column], x: Column, y: Column) -> tuple[Column, Column, Column]:
    """A point through a 3x3 homography (row-major): x, y and the divisor; null where the divisor is 0. [SFN-01, SFN-36]"""
    w = h[6] * x + h[7] * y + h[8]
    return F.try_divide(h[0] * x + h[1] * y + h[2], w), F.try_divide(h[3] * x + h[4] * y + h[5], w), w


def product(a: list[Column], b: list[Column]) -> list[Column]:
    """Product of two 3x3 matrices. [SFN-02]"""
    return [a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)]


def adjugate(a: list[Column]) -> list[Column]:
    """The inverse of a 3x3 matrix up to its determinant. [SFN-02]"""
    c = lambda i, j, k, m: a[i] * a[m] - a[j] * a[k]
    return [c(4, 5, 7, 8), c(2, 1, 8, 7), c(1, 2, 4, 5), c(5, 3, 8, 6), c(0, 2, 6, 8), c(2, 0, 5, 3), c(3, 4, 6, 7), c(1, 0, 7, 6), c(0, 1, 3, 4)]


def determinant(a: list[Column]) -> Column:
    return a[0] * (a[4] * a[8] - a[5] * a[7]) - a[1] * (a[3] * a[8] - a[5] * a[6]) + a[2] * (a[3] * a[7] - a[4] * a[6])


def blended(first: tuple[Column, Column], second: tuple[Column, Column], weight: Column) -> tuple[Column, Column]:
    """Two projections mixed by the second's weight. [SFN-04, WIN-19]"""
    mix = lambda a, b: F.when(weight <= 0, a).when(weight >= 1, b).otherwise(a * (1 - weight) + b * weight)
    return mix(first[0], second[0]), mix(first[1], second[1])


def overlap(a: list[Column], b: list[Column]) -> tuple[Column, Column]:
    """Intersection and union area of two boxes (x1, y1, x2, y2). [SFN-05]"""
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    both = side(0, 2) * side(1, 3)
    return both, area(a) + area(b) - both


def overlap_ratio(a: list[Column], b: list[Column]) -> Column:
    """Intersection of two boxes over their union. [SFN-05]"""
    both, whole = overlap(a, b)
    return both / (whole + 1e-9)


def foot(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Bottom centre of a box. [PRJ-01]"""
    return (x1 + x2) / 2, y2


def mirrored(flip: Column, period: Column, at: Column, length: float) -> Column:
    """A coordinate in the first half's direction; an unknown flip means the second half. [PRJ-02, FLT-15]"""
    return F.when(F.coalesce(flip, period == 2, F.lit(False)), length - at).otherwise(at)


def metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on a small part of the globe. [SFN-07]"""
    east = F.radians(lon2 - lon1) * EARTH_M * F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot(east, F.radians(lat2 - lat1) * EARTH_M)


def wrapped(degrees: Column) -> Column:
    """An angle in [-180, 180); one that is there stays as it is, to the last digit. [SFN-31]"""
    return F.when((degrees >= -180) & (degrees < 180), degrees).otherwise(F.pmod(degrees + 180, F.lit(360)) - 180)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a line segment. [JOI-18]"""
    dx, dy = bx - ax, by - ay
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))))
    return F.hypot(px - (ax + u * dx), py - (ay + u * dy))
