"""Positions on the globe and on a pitch as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackmill.functions.geometry import EARTH_M, EARTH_M_PER_DEGREE, adjugate, projected, segment_distance


def local_metres(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """East and north of a point around (lat0, lon0). [SFN-08]"""
    return F.radians(lon - lon0) * EARTH_M * F.cos(F.radians(lat0)), F.radians(lat - lat0) * EARTH_M


def effective_accuracy(lat: Column, lon: Column, accuracy: Column) -> Column:
    """How far off a position may be: positions of four decimals add half a step each way; unknown accuracy is 8 m. [SFN-11]"""
    coarse = lambda v: F.abs(v * 1e4 - F.rint(v * 1e4)) < 1e-6
    known = F.coalesce(accuracy.cast("double"), F.lit(8.0))
    half = 0.5e-4 * EARTH_M_PER_DEGREE
    wide = F.round(F.hypot(known, F.hypot(F.lit(half), half * F.cos(F.radians(lat)))), 1)
    return F.when(lat.isNull() | lon.isNull(), accuracy).when(coarse(lat) & coarse(lon), wide).otherwise(known)


def _local(corners: Column) -> Column:
    """Corners (array of structs lat, lon) as an array of structs x, y around their mean."""
    mean = lambda f: F.aggregate(corners, F.lit(0.0), lambda s, c: s + c[f]) / 4

    def around(c: Column) -> Column:
        x, y = local_metres(c["lat"], c["lon"], mean("lat"), mean("lon"))
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(corners, around)


def _gap(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def ordered_corners(corners: Column, near: tuple[Column, Column] | None = None) -> Column:
    """Four corners in any order as near left, near right, far right, far left, seen from `near` or else from the first two; null for other numbers. [SFN-12]"""
    local = _local(corners)
    turn = F.array_sort(F.transform(local, lambda p, i: F.struct(F.atan2(p["y"], p["x"]).alias("at"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y"))))
    p = lambda k: F.get(turn, F.lit(k % 4))
    side = [_gap(p(k + 1), p(k)) for k in range(4)]
    if near is None:
        me = ((F.get(local, F.lit(0))["x"] + F.get(local, F.lit(1))["x"]) / 2, (F.get(local, F.lit(0))["y"] + F.get(local, F.lit(1))["y"]) / 2)
    else:
        mean = lambda f: F.aggregate(corners, F.lit(0.0), lambda s, c: s + c[f]) / 4
        me = local_metres(*near, mean("lat"), mean("lon"))
    away = [F.hypot((p(k)["x"] + p(k + 1)["x"]) / 2 - me[0], (p(k)["y"] + p(k + 1)["y"]) / 2 - me[1]) for k in range(4)]
    even = side[0] + side[2] >= side[1] + side[3]
    first = F.when(even, F.when(away[0] <= away[2], 0).otherwise(2)).otherwise(F.when(away[1] <= away[3], 1).otherwise(3))
    found = F.array(*[F.get(corners, F.get(turn, (first + k) % 4)["i"]) for k in range(4)])
    return F.when(F.size(corners) == 4, found)


def pitch_size(corners: Column) -> tuple[Column, Column]:
    """Length and width in half metres of ordered corners; null where that is no pitch or wider than long. [SFN-12]"""
    p = lambda k: F.get(_local(corners), F.lit(k))
    length, width = (_gap(p(0), p(1)) + _gap(p(3), p(2))) / 2, (_gap(p(0), p(3)) + _gap(p(1), p(2))) / 2
    ok = (F.size(corners) == 4) & length.between(40, 130) & width.between(25, 100) & (width <= length)
    return F.when(ok, F.rint(length * 2) / 2), F.when(ok, F.rint(width * 2) / 2)


def on_pitch(lat: Column, lon: Column, corners: Column, length: float, width: float) -> tuple[Column, Column]:
    """A position in pitch coordinates: the perspective that takes the ordered corners to the pitch's. [SFN-13]

    The matrix from the unit square to the corners in closed form, and its adjugate back.
    """
    mean = lambda f: F.aggregate(corners, F.lit(0.0), lambda s, c: s + c[f]) / 4
    at = lambda k, f: F.get(_local(corners), F.lit(k))[f]
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = ((at(k, "x"), at(k, "y")) for k in (3, 2, 1, 0))
    sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    dx1, dx2, dy1, dy2 = x1 - x2, x3 - x2, y1 - y2, y3 - y2
    det = dx1 * dy2 - dx2 * dy1
    g, h = F.try_divide(sx * dy2 - dx2 * sy, det), F.try_divide(dx1 * sy - sx * dy1, det)
    m = [x1 - x0 + g * x1, x3 - x0 + h * x3, x0, y1 - y0 + g * y1, y3 - y0 + h * y3, y0, g, h, F.lit(1.0)]
    u, v, _ = projected(adjugate(m), *local_metres(lat, lon, mean("lat"), mean("lon")))
    return u * length, v * width


def pitch_distance(lat: Column, lon: Column, corners: Column) -> Column:
    """Metres from a position to the nearest edge of the corners' polygon. [JOI-18]"""
    at = lambda k: local_metres(F.get(corners, F.lit(k))["lat"], F.get(corners, F.lit(k))["lon"], lat, lon)
    zero = F.lit(0.0)
    return F.least(*[segment_distance(zero, zero, *at(k), *at((k + 1) % 4)) for k in range(4)])
