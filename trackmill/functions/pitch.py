"""The pitch's marks as tables: places, straight lines, goal frames, and points along all lines."""

from __future__ import annotations

from math import acos, hypot, pi, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sizes in metres that the laws of the game fix: penalty and goal area (depth, half width), half a goal, its height, circles, penalty spot.
PENALTY, GOAL_AREA, HALF_GOAL, GOAL_HEIGHT, CIRCLE, SPOT = (16.5, 20.16), (5.5, 9.16), 3.66, 2.44, 9.15, 11.0
SIDES = ("left", "right")


def landmarks(spark: SparkSession, length: float = 105.0, width: float = 68.0) -> DataFrame:
    """(name, x, y) of every place that can be clicked on. [SFN-29]"""
    mid, half = width / 2, length / 2
    at = {f"corner {s} {e}": (x, y) for s, x in zip(SIDES, (0.0, length), strict=True) for e, y in (("top", 0.0), ("bottom", width))}
    at |= {"halfway top": (half, 0.0), "halfway bottom": (half, width), "centre spot": (half, mid)}
    at |= {f"centre circle {n}": (half + dx * CIRCLE, mid + dy * CIRCLE) for n, dx, dy in (("top", 0, -1), ("bottom", 0, 1), ("left", -1, 0), ("right", 1, 0))}
    arc = sqrt(CIRCLE**2 - (PENALTY[0] - SPOT) ** 2)
    for side, x, into in ((SIDES[0], 0.0, 1), (SIDES[1], length, -1)):
        at[f"penalty spot {side}"] = (x + into * SPOT, mid)
        for end, dy in (("top", -1), ("bottom", 1)):
            for name, (deep, wide) in (("penalty area", PENALTY), ("goal area", GOAL_AREA)):
                at[f"{name} {side} corner {end}"] = (x + into * deep, mid + dy * wide)
                at[f"{name} {side} goal line {end}"] = (x, mid + dy * wide)
            at[f"goal post {side} {end}"] = (x, mid + dy * HALF_GOAL)
            at[f"penalty arc {side} {end}"] = (x + into * PENALTY[0], mid + dy * arc)
    return spark.createDataFrame([(n, round(x, 3), round(y, 3)) for n, (x, y) in at.items()], "name string, x double, y double")


def straight_lines(length: float = 105.0, width: float = 68.0) -> dict[str, tuple[float, float, float, float]]:
    mid, half = width / 2, length / 2
    out = {"touchline top": (0, 0, length, 0), "touchline bottom": (0, width, length, width), "halfway line": (half, 0, half, width), "goal line left": (0, 0, 0, width), "goal line right": (length, 0, length, width)}
    for side, x, into in ((SIDES[0], 0.0, 1), (SIDES[1], length, -1)):
        for name, (deep, wide) in (("penalty area", PENALTY), ("goal area", GOAL_AREA)):
            to = x + into * deep
            out[f"{name} {side} front"] = (to, mid - wide, to, mid + wide)
            out[f"{name} {side} top"] = (x, mid - wide, to, mid - wide)
            out[f"{name} {side} bottom"] = (x, mid + wide, to, mid + wide)
    return {n: tuple(map(float, v)) for n, v in out.items()}


def segments(spark: SparkSession, length: float = 105.0, width: float = 68.0) -> DataFrame:
    """(name, ax, ay, bx, by) of every straight line. [SFN-29]"""
    return spark.createDataFrame([(n, *v) for n, v in straight_lines(length, width).items()], "name string, ax double, ay double, bx double, by double")


def goal_frames(spark: SparkSession, length: float = 105.0, width: float = 68.0) -> DataFrame:
    """(name, ax, ay, bx, by, up): tops of the goal posts (both ends alike) and the crossbars, above the ground. [SFN-29]"""
    rows = []
    for side, x in zip(SIDES, (0.0, length), strict=True):
        ends = [(x, round(width / 2 + dy * HALF_GOAL, 3)) for dy in (-1, 1)]
        rows += [(f"goal post {side} {e}, top end", *p, *p, GOAL_HEIGHT) for e, p in zip(("top", "bottom"), ends, strict=True)]
        rows.append((f"crossbar {side}", *ends[0], *ends[1], GOAL_HEIGHT))
    return spark.createDataFrame(rows, "name string, ax double, ay double, bx double, by double, up double")


def line_samples(spark: SparkSession, step: float = 0.5, length: float = 105.0, width: float = 68.0) -> DataFrame:
    """(line, i, x, y, dx, dy): points along all lines, circles and arcs about `step` metres apart, with the line's direction. [CAL-09]"""
    lines = [(n, ax, ay, bx - ax, by - ay, None, None, None, max(2, int(hypot(bx - ax, by - ay) / step) + 1)) for n, (ax, ay, bx, by) in straight_lines(length, width).items()]
    open_ = acos((PENALTY[0] - SPOT) / CIRCLE)
    for name, cx, a0, a1 in (("centre circle", length / 2, 0.0, 2 * pi), ("penalty arc left", SPOT, -open_, open_), ("penalty arc right", length - SPOT, pi - open_, pi + open_)):
        lines.append((name, cx, width / 2, None, None, CIRCLE, a0, a1, max(8, int(CIRCLE * (a1 - a0) / step))))
    df = spark.createDataFrame(lines, "line string, ax double, ay double, wx double, wy double, r double, a0 double, a1 double, n int")
    df = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("u", F.col("i") / (F.col("n") - 1))
    angle = F.col("a0") + F.col("u") * (F.col("a1") - F.col("a0"))
    whole = F.hypot("wx", "wy")
    bent = F.col("r").isNotNull()
    return df.select(
        "line", "i", F.when(bent, F.col("ax") + F.col("r") * F.cos(angle)).otherwise(F.col("ax") + F.col("u") * F.col("wx")).alias("x"),
        F.when(bent, F.col("ay") + F.col("r") * F.sin(angle)).otherwise(F.col("ay") + F.col("u") * F.col("wy")).alias("y"),
        F.when(bent, -F.sin(angle)).otherwise(F.col("wx") / whole).alias("dx"), F.when(bent, F.cos(angle)).otherwise(F.col("wy") / whole).alias("dy"),
    )


def keyframe_grid(h: list[Column], width_px: Column, height_px: Column, length: float = 105.0, width: float = 68.0, most: int = 12) -> Column:
    """Clicks (array of structs x, y, px, py) that stand for a pitch-to-image matrix: of a grid of 15 by 9 places those in the image, thinned evenly to 12; empty below 4. [CAL-09]"""
    places = F.array(*[F.struct(F.lit(length * i / 14).alias("px"), F.lit(width * j / 8).alias("py")) for j in range(9) for i in range(15)])
    w = lambda p: h[6] * p["px"] + h[7] * p["py"] + h[8]
    u = lambda p: (h[0] * p["px"] + h[1] * p["py"] + h[2]) / F.when(w(p) > 1e-6, w(p))
    v = lambda p: (h[3] * p["px"] + h[4] * p["py"] + h[5]) / F.when(w(p) > 1e-6, w(p))
    seen = F.filter(F.transform(places, lambda p: F.struct(F.round(u(p), 2).alias("x"), F.round(v(p), 2).alias("y"), F.round(p["px"], 3).alias("px"), F.round(p["py"], 3).alias("py"))), lambda c: c["x"].between(0, width_px) & c["y"].between(0, height_px))

    def thinned(s: Column) -> Column:
        n = F.size(s)
        few = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.get(s, F.floor(k * (n - 1) / (most - 1)).cast("int")))
        return F.when(n < 4, F.slice(s, 1, 0)).when(n > most, few).otherwise(s)

    return F.element_at(F.transform(F.array(seen), thinned), 1)
