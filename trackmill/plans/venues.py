"""Where a match was filmed: known pitches and camera places near a clip, and the pitch in a map around it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.functions.geometry import EARTH_M
from trackmill.operators import spatial
from trackmill.operators.calibration import with_struct

#: Metres within which a venue's size, a filming spot and a clicked pitch are the same; least length and width of a pitch in a map (fixed values).
VENUE_M, SPOT_M, PITCH_M, LEAST_LENGTH, LEAST_WIDTH = 150.0, 8.0, 30.0, 40.0, 25.0


def known_size(matches: DataFrame, venues: DataFrame) -> DataFrame:
    """(id, venue_id, pitch_length, pitch_width, metres): for matches (id, lat, lon) the size of the nearest known venue (id, lat, lon, pitch_length, pitch_width) within 150 m. [JOI-17]"""
    v = venues.where("pitch_length is not null").select(F.col("id").alias("venue_id"), "lat", "lon", "pitch_length", "pitch_width")
    return spatial.nearest_within(matches, v, VENUE_M, "id", "venue_id").join(v.drop("lat", "lon"), "venue_id").select("id", "venue_id", "pitch_length", "pitch_width", "metres")


def remembered(venues: DataFrame, matches: DataFrame) -> DataFrame:
    """Which venue a match's pitch updates (match id, venue_id; null: a new one). Both with corners or without (boolean `corners`), id, lat, lon. [JOI-17, STA-14]

    A pitch whose corners are known is the clicked one whose middle is within 30 m, else a venue of which only the size is known within 150 m; without corners only the latter.
    """
    seen = venues.select(F.col("id").alias("venue_id"), "lat", "lon", "corners")
    clicked = spatial.nearest_within(matches.where("corners"), seen.where("corners"), PITCH_M, "id", "venue_id").select("id", F.col("venue_id").alias("a"))
    sized = spatial.nearest_within(matches, seen.where("not corners"), VENUE_M, "id", "venue_id").select("id", F.col("venue_id").alias("b"))
    return matches.select("id").join(clicked, "id", "left").join(sized, "id", "left").select("id", F.coalesce("a", "b").alias("venue_id"))


def shared_cameras(clips: DataFrame) -> DataFrame:
    """(id, from_id, cam_x, cam_y, cam_h, metres): clips without a camera place take that of the nearest clip of their match within 8 m whose place was set by hand. [STA-14, JOI-17]

    clips: id, match_id, gps_lat, gps_lon, cam_x, cam_y, cam_h, cam_source.
    """
    c = clips.withColumnsRenamed({"gps_lat": "lat", "gps_lon": "lon"})
    known = c.where("cam_source = 'hand' and cam_x is not null").select(F.col("id").alias("from_id"), F.col("match_id").alias("from_match"), "lat", "lon", "cam_x", "cam_y", "cam_h")
    pairs = spatial.within(c.where("cam_x is null"), known, SPOT_M, "id", "from_id").join(c.select("id", "match_id"), "id").join(known.drop("lat", "lon"), "from_id")
    best = F.min(F.struct("metres", "from_id", "cam_x", "cam_y", "cam_h"))
    return pairs.where("match_id = from_match").groupBy("id").agg(best.alias("m")).select("id", "m.from_id", "m.cam_x", "m.cam_y", "m.cam_h", "m.metres")


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull in order, from two chains of turns to one side."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(rows: np.ndarray) -> list:
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def least_rectangle(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """The smallest rectangle around points: middle, direction of its longer side, length, width. One side lies on the hull's."""
    h = hull(points)
    side = np.roll(h, -1, 0) - h
    side = side[np.hypot(*side.T) > 0]
    u = side / np.hypot(*side.T)[:, None] if len(side) else np.array([[1.0, 0.0]])
    v = np.stack([-u[:, 1], u[:, 0]], 1)
    a, b = h @ u.T, h @ v.T
    wide, tall = np.ptp(a, 0), np.ptp(b, 0)
    k = int((wide * tall).argmin())
    middle = u[k] * (a[:, k].max() + a[:, k].min()) / 2 + v[k] * (b[:, k].max() + b[:, k].min()) / 2
    return (middle, u[k], wide[k], tall[k]) if wide[k] >= tall[k] else (middle, v[k], tall[k], wide[k])


def outside_by(points: np.ndarray) -> float:
    """How far the origin is from a polygon; 0 inside."""
    a, b = points, np.roll(points, -1, 0)
    d = b - a
    share = np.clip(-(a * d).sum(1) / np.maximum((d**2).sum(1), 1e-12), 0, 1)
    far = np.hypot(*(a + share[:, None] * d).T).min()
    crosses = ((a[:, 1] > 0) != (b[:, 1] > 0)) & (0 < a[:, 0] - a[:, 1] * d[:, 0] / np.where(d[:, 1] == 0, 1, d[:, 1]))
    return 0.0 if crosses.sum() % 2 else float(far)


def on_nearest_pitch(lat: float, lon: float, polygons: list, length: float, width: float) -> dict | None:
    best = None
    for ring in polygons:
        p = np.array([[c["lat"], c["lon"]] for c in ring if c is not None and c["lat"] is not None and c["lon"] is not None], float).reshape(-1, 2)
        if len(p) < 3:
            continue
        at = np.stack([np.radians((p[:, 1] - lon + 180) % 360 - 180) * EARTH_M * np.cos(np.radians(lat)), np.radians(p[:, 0] - lat) * EARTH_M], 1)
        middle, along, long, short = least_rectangle(at)
        if long >= LEAST_LENGTH and short >= LEAST_WIDTH and (best is None or outside_by(at) < best[0]):
            best = (outside_by(at), middle, along, long, short)
    if best is None:
        return None
    away, middle, along, long, short = best
    toward = np.array([-along[1], along[0]])
    toward = toward if -middle @ toward >= 0 else -toward  # to the camera's touchline
    right = np.array([-toward[1], toward[0]])
    along = along if along @ right >= 0 else -along
    x, y = length / 2 - middle @ along * length / long, width / 2 - middle @ toward * width / short
    return {"x": round(float(x), 1), "y": round(float(y), 1), "pitch_length": round(float(long), 1), "pitch_width": round(float(short), 1), "distance_to_pitch": round(away, 1)}


def camera_on_pitch(clips: DataFrame, length: str = "length", width: str = "width", result: str = "place") -> DataFrame:
    """Clips (lat, lon, polygons: array of arrays of structs lat, lon; the match's pitch length and width) without `polygons`, with a struct `result`: the camera's place on the nearest
    pitch of the map, that pitch's size and distance; null without any of 40 by 25 metres. Null polygons and corners are left out. [SFN-14]

    A pitch is the smallest rectangle around its polygon; its lower touchline is the camera's. Rows stay where they are; a row's polygons are those around its clip.
    """
    corner = lambda c, i: F.struct(i.alias("ring"), c["lat"].alias("lat"), c["lon"].alias("lon"))
    flat = F.flatten(F.transform("polygons", lambda ring, i: F.transform(F.coalesce(ring, F.array().cast(clips.schema["polygons"].dataType.elementType)), lambda c: corner(c, i))))
    asked = clips.withColumn("__corners", flat).drop("polygons")

    def made(g: pd.DataFrame) -> list:
        out = []
        for lat, lon, corners, a, b in zip(g["lat"], g["lon"], g["__corners"], g[length], g[width], strict=True):
            rings: dict[int, list] = {}
            for c in corners if corners is not None and not pd.isna(lat) and not pd.isna(lon) else []:
                rings.setdefault(c["ring"], []).append(c)
            out.append(on_nearest_pitch(lat, lon, list(rings.values()), a, b))
        return out

    return with_struct(asked, result, "struct<x: double, y: double, pitch_length: double, pitch_width: double, distance_to_pitch: double>", made).drop("__corners")
