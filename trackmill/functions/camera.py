"""Cameras, clicks and boxes as column expressions."""

from __future__ import annotations

from math import radians, tan

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackmill.functions.geometry import determinant, product, projected

#: Horizontal field of view of a phone (fixed value, degrees).
FIELD_OF_VIEW = 57.0


def oriented(h: list[Column], points: Column) -> list[Column]:
    """A homography with the sign that puts most clicked points (array of structs x, y) before the camera. [SFN-03]"""
    signs = F.aggregate(points, F.lit(0.0), lambda s, p: s + F.signum(h[6] * p["x"] + h[7] * p["y"] + h[8]))
    sign = F.when(signs < 0, -1.0).otherwise(1.0)
    return [x * sign for x in h]


def mirrored_view(h: list[Column]) -> Column:
    """Whether an image-to-pitch homography shows the pitch as in a mirror. [STA-13]"""
    return determinant(h) < 0


def unmirrored(h: list[Column], cx: Column, cy: Column) -> tuple[list[Column], list[Column]]:
    """The homography mirrored back at the upright and at the level line through (cx, cy). [STA-13]"""
    one, zero = F.lit(1.0), F.lit(0.0)
    return product([-one, zero, 2 * cx, zero, one, zero, zero, zero, one], h), product([one, zero, zero, zero, -one, 2 * cy, zero, zero, one], h)


def degrees_of_freedom(points: Column) -> Column:
    """What clicks (array of structs pitch, line) tell: two a point, two a line at most. [SFN-23]"""
    lines = F.filter(F.transform(points, lambda p: F.when(p["pitch"].isNull(), p["line"])), lambda x: x.isNotNull())
    per = F.transform(F.array_distinct(lines), lambda x: F.least(F.lit(2), F.size(F.filter(lines, lambda y: y == x))))
    return 2 * F.size(F.filter(points, lambda p: p["pitch"].isNotNull())) + F.aggregate(per, F.lit(0), lambda s, n: s + n)


def residual(h: list[Column], ix: Column, iy: Column, px: Column, py: Column) -> Column:
    """Metres between a click through an image-to-pitch homography and its pitch point. [SFN-24]"""
    x, y, _ = projected(h, ix, iy)
    return F.hypot(x - px, y - py)


def line_residual(h: list[Column], ix: Column, iy: Column, a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Metres between a click through a homography and the line through a and b. [SFN-24]"""
    x, y, _ = projected(h, ix, iy)
    dx, dy = b[0] - a[0], b[1] - a[1]
    return F.abs((x - a[0]) * dy - (y - a[1]) * dx) / F.nullif(F.hypot(dx, dy), F.lit(0.0))


def click_weight(zoom: Column) -> Column:
    """Clicks made when zoomed in count more, up to four times. [SFN-40]"""
    return F.least(F.lit(4.0), F.greatest(F.lit(1.0), F.coalesce(F.nullif(zoom.try_cast("double"), F.lit(0.0)), F.lit(1.0))))


def default_focal(width: Column) -> Column:
    return width / 2 / tan(radians(FIELD_OF_VIEW / 2))


def camera_prior(source: Column, x: Column, y: Column, height: Column, focal: Column, gps_accuracy: Column, width: Column, yaw_degrees: Column) -> Column:
    """What is known of a clip's camera (struct x, y, height, focal, uncertain, yaw, as fits take it); null without a place or width. [SFN-32]

    A place set by hand or taken from a station is sure to 3 m, another to its accuracy (8 m where unknown) and 3 m more, 4 m at least.
    """
    sure = F.when(source.isin("hand", "station"), 3.0).otherwise(F.greatest(F.lit(4.0), F.coalesce(F.nullif(gps_accuracy, F.lit(0.0)), F.lit(8.0)) + 3.0))
    lens = F.coalesce(F.nullif(focal, F.lit(0.0)), default_focal(width))
    known = F.struct(x.alias("x"), y.alias("y"), F.coalesce(F.nullif(height, F.lit(0.0)), F.lit(1.6)).alias("height"), lens.alias("focal"), sure.alias("uncertain"), F.radians(yaw_degrees).alias("yaw"))
    return F.when(x.isNotNull() & y.isNotNull() & (width > 0), known)


def camera_homography(x: Column, y: Column, height: Column, yaw: Column, tilt: Column, roll: Column, log_f: Column, width_px: Column, height_px: Column) -> list[Column]:
    """Pitch-to-image homography of a camera (metres, radians, log of the focal length), its last element of size one. [SFN-32]

    Three turns one after the other take the world's axes (along, across, down) to the camera's (right, down, ahead); the pitch is
    the plane at the camera's height, seen from the place above (x, y); the lens scales and shifts to pixels.
    """
    zero, one = F.lit(0.0), F.lit(1.0)
    about_down = [-F.sin(yaw), F.cos(yaw), zero, zero, zero, one, F.cos(yaw), F.sin(yaw), zero]
    about_right = [one, zero, zero, zero, F.cos(tilt), -F.sin(tilt), zero, F.sin(tilt), F.cos(tilt)]
    about_ahead = [F.cos(roll), F.sin(roll), zero, -F.sin(roll), F.cos(roll), zero, zero, zero, one]
    plane = [one, zero, -x, zero, one, -y, zero, zero, height]
    focal = F.exp(F.least(F.greatest(log_f, zero), F.lit(15.0)))
    lens = [focal, zero, width_px / 2, zero, focal, height_px / 2, zero, zero, one]
    m = product(lens, product(about_ahead, product(about_right, product(about_down, plane))))
    size = F.abs(m[8])
    return [v / F.when(size > 1e-12, size).otherwise(1.0) for v in m]


def candidate(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column, Column]:
    """Centre and size of a detected ball. [SFN-33]"""
    return (x1 + x2) / 2, (y1 + y2) / 2, F.greatest(x2 - x1, y2 - y1)


def moved_box(h: list[Column], x1: Column, y1: Column, x2: Column, y2: Column) -> list[Column]:
    """A box moved with the camera: foot and head through the homography, the width with the height. [SFN-38]"""
    cx, foot, _ = projected(h, (x1 + x2) / 2, y2)
    _, top, _ = projected(h, (x1 + x2) / 2, y1)
    w = (x2 - x1) * F.greatest(F.lit(1.0), foot - top) / F.greatest(F.lit(1.0), y2 - y1)
    return [cx - w / 2, top, cx + w / 2, foot]


def ball_gate(size: Column, lost: Column) -> Column:
    """How far from its expected place a ball is looked for. [SFN-20]"""
    return 40.0 + 6.0 * F.sqrt(size) + 30.0 * F.least(lost, F.lit(10))


def ball_predicted(at: Column, speed: Column, lost: Column, most: Column) -> Column:
    """Where a ball is expected on an axis, at most eight frames ahead; null when lost for over 25. [SFN-20]"""
    ahead = at + speed * F.least(lost + 1, F.lit(8))
    return F.when(lost <= 25, F.least(F.greatest(ahead, F.lit(0.0)), most - 1))


def match_score(iou: Column, foot: Column, height: Column, other_height: Column, lost: Column, colour: Column) -> Column:
    """How well a box fits a track: overlap or foot distance, size, shirt colour (null: unknown). [SFN-06]"""
    h = F.greatest(F.lit(1.0), height)
    near = F.exp(-0.5 * F.pow(foot / (0.35 * h * (1 + 0.5 * F.least(lost, F.lit(10)))), 2))
    size = F.exp(-0.5 * F.pow(F.log(F.greatest(F.lit(1.0), other_height) / h) / 0.25, 2))
    return F.greatest(iou, near) * size * F.coalesce(0.1 + 0.9 * F.exp(-0.5 * F.pow(colour / 12, 2)), F.lit(1.0))


def continuity(gap: Column, distance: Column) -> Column:
    """How likely a track goes on in one that begins `gap` seconds later `distance` metres away; none when they overlap by over 0.3 s. [SFN-17]"""
    g = F.greatest(gap, F.lit(0.0))
    half = 0.5 * (2.0 + 6.0 * g)
    return F.when(gap < -0.3, 0.0).when(distance.isNotNull(), F.exp(-0.5 * F.pow(F.greatest(F.lit(0.0), distance - half) / half, 2)) * F.exp(-g / 40.0))


def continuity_seen(gap: Column, moved: Column, ratio: Column) -> Column:
    """The same without calibration: `moved` is in body heights, the camera's motion taken out; a sudden change of height (ratio) within 3 s makes it unlikely. [SFN-17]"""
    g = F.greatest(gap, F.lit(0.0))
    half = 0.5 * (1.0 + 3.5 * g)
    other = F.when((g < 3) & ~((ratio > 0.6) & (ratio < 1.6)), 0.3).otherwise(1.0)
    return F.when(gap < -0.3, 0.0).otherwise(F.exp(-0.5 * F.pow(F.greatest(F.lit(0.0), moved - half) / half, 2)) * other * F.exp(-g / 40.0))


def link_score(fit: Column, rival: Column, colour: Column, look: Column, same_number: Column | None = None) -> Column:
    """Score of a track for a player from its fit, a team mate's, shirt distance, likeness to the profile, and whether it shows the player's number (null: unknown). [SFN-18]"""
    s = (0.3 + 0.7 * fit) * F.when(rival > fit + 0.2, 0.5).otherwise(1.0) * F.coalesce(0.15 + 0.85 * F.exp(-0.5 * F.pow(colour / 12.0, 2)), F.lit(1.0))
    likeness = F.when(look.isNotNull(), 0.5 + F.least(F.lit(1.0), F.greatest(F.lit(0.0), (look + 0.1) / 0.6))).otherwise(1.0)
    number = F.lit(1.0) if same_number is None else F.when(same_number, 1.4).when(~same_number, 0.3).otherwise(1.0)
    return F.least(F.lit(1.0), s * likeness * number)


def link_reasons(gap: Column, distance: Column, rival: Column, fit: Column, colour: Column, look: Column | None = None, later: Column | None = None) -> Column:
    """The same as text. [SFN-18]"""
    when = F.lit("after") if later is None else F.when(later, "after").otherwise("before")
    parts = F.array(
        F.when(gap.isNotNull(), F.format_string("follows %s %.1f s", when, gap)), F.when(distance.isNotNull(), F.format_string("%.0f m away", distance)),
        F.when(colour < 8, "same shirt").when(colour < 16, "similar shirt").when(colour.isNotNull(), "other shirt?"), F.when(rival > fit + 0.2, "fits a team mate too"),
        F.lit(None).cast("string") if look is None else F.when(look >= 0.35, "looks like the profile").when(look < 0.05, "does not look like the profile"),
    )
    return F.array_join(F.array_compact(parts), ", ")


def ball_diameter(boxes: Column, y: Column) -> Column:
    """Pixels of a ball at height y in the image, from the person (array of structs y1, y2) whose foot is nearest; 10 without any. [SFN-26]"""
    nearest = F.array_min(F.transform(boxes, lambda b, i: F.struct(F.abs(b["y2"] - y).alias("d"), i.alias("i"), (b["y2"] - b["y1"]).alias("h"))))
    return F.coalesce(F.least(F.lit(60.0), F.greatest(F.lit(5.0), 0.125 * nearest["h"])), F.lit(10.0))


def heat_shade(value: Column, most: Column) -> Column:
    """Shade of a heat map's cell. [SFN-39]"""
    return F.coalesce(F.sqrt(F.try_divide(value, most)), F.lit(0.0))


def rescaled_camera(x: Column, y: Column, old: tuple[float, float], new: tuple[float, float]) -> tuple[Column, Column]:
    """A camera's place after the pitch's size changed: beside the pitch it keeps its distance. [PRJ-07]"""
    at = F.when(y > old[1], new[1] + (y - old[1])).when(y < 0, y).otherwise(y * new[1] / old[1])
    return F.round(x * new[0] / old[0], 1), F.round(at, 1)


def remapped(points: Column, landmarks: Column) -> Column:
    """Clicks (array of structs name, x, y) at the places that a map of name to struct x, y gives; unknown names stay. [PRJ-06]"""

    def moved(p: Column) -> Column:
        q = F.try_element_at(landmarks, p["name"])
        return F.struct(p["name"].alias("name"), F.coalesce(q["x"], p["x"]).alias("x"), F.coalesce(q["y"], p["y"]).alias("y"))

    return F.transform(points, moved)


def confidence(review: Column, own: Column, own_bad: Column, lines: Column, method: Column, unsure: Column, turn: Column, coverage: Column) -> Column:
    """Percent of trust in a clip's calibration; null where there is none or it was rejected. [SFN-25]

    own, own_bad: its own keyframes and those that don't fit; lines, method, unsure, turn: of its best proposal (turn null: no proposal).
    """
    proposed = F.when(method == "lines", 75).when(lines & unsure, 80).when(lines, 90).otherwise(70) - F.when(turn > 45, 20).otherwise(0)
    base = F.when(review == "approved", 97).when((own > 0) & (own_bad > 0), 55).when(own > 0, 95).when(turn.isNotNull(), proposed)
    base = F.when(F.coalesce(review.isin("failed", "rejected"), F.lit(False)) | ((own == 0) & turn.isNull()), None).otherwise(base)
    return F.when(base.isNotNull(), F.rint(F.least(F.lit(99.0), F.greatest(F.lit(0.0), base * (0.6 + 0.4 * coverage)))).cast("int"))


def better_model(ball: Column, old_ball: Column, person: Column, old_person: Column) -> Column:
    """Whether a trained detector replaces the last one: clearly better at one kind, not worse at the other. [STA-15]"""
    v = lambda c: F.coalesce(c, F.lit(0.0))
    b, ob, p, op = v(ball), v(old_ball), v(person), v(old_person)
    return ((b > ob + 0.01) & (p >= op - 0.02)) | ((p > op + 0.02) & (b >= ob - 0.01))


def time_estimate(items: Column, epochs: Column, per_item: float) -> Column:
    """Minutes that a training takes, one at least. [AGG-35]"""
    return F.greatest(F.lit(1), F.ceil(items * epochs * per_item / 60).cast("int"))
