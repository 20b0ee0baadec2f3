"""Calibration, paths and rounds on the driver's tables: each user films from a place of their own, and each kind of event is a pitch place that they click on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.functions import camera, geometry
from trackmill.operators import calibration, rounds
from trackmill.plans.registry import EVENTS_SQL, events, query

#: The users' cameras: place beside the pitch, height, turn, tilt, focal length; a click is the first event of a user, kind and week.
CAMERAS_SQL = """, u AS (SELECT DISTINCT user_id AS u FROM b), cam AS (SELECT u, 20.0 + (u * 7) % 65 AS x, 74.0 + u % 9 AS y, 3.0 + u % 5 AS height,
  radians(-90.0 + (u * 11) % 41 - 20) AS yaw, radians(5.0 + u % 6) AS tilt, 1000.0 + (u * 13) % 700 AS focal FROM u),
 c AS (SELECT user_id AS u, kind, day // 7 AS week, min(struct_pack(us := us, id := event_id, px := CAST(v % 106 AS DOUBLE), py := CAST((us // 1000000) % 69 AS DOUBLE))) AS m FROM b GROUP BY ALL),
 p AS (SELECT c.u, m.id AS id, m.px AS px, m.py AS py, cam.*, cos(yaw) * cos(tilt) * (m.px - x) + sin(yaw) * cos(tilt) * (m.py - y) + sin(tilt) * height AS depth,
  -sin(yaw) * (m.px - x) + cos(yaw) * (m.py - y) AS beside, -cos(yaw) * sin(tilt) * (m.px - x) - sin(yaw) * sin(tilt) * (m.py - y) + cos(tilt) * height AS below FROM c JOIN cam ON c.u = cam.u),
 s AS (SELECT *, focal * beside / depth + 960 AS ix, focal * below / depth + 540 AS iy FROM p WHERE depth > 1),
 k AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY u) AS n FROM s WHERE ix BETWEEN -400 AND 2320 AND iy BETWEEN -400 AND 1480)"""


def cameras(spark, sf) -> DataFrame:
    u = F.col("u")
    return events(spark, sf).select(F.col("user_id").alias("u")).distinct().select(
        "u", (20.0 + u * 7 % 65).alias("x"), (74.0 + u % 9).alias("y"), (3.0 + u % 5).alias("height"), F.radians(-90.0 + u * 11 % 41 - 20).alias("yaw"),
        F.radians(5.0 + u % 6).alias("tilt"), F.lit(0.0).alias("roll"), (1000.0 + u * 13 % 700).alias("focal"),
    )


def view() -> Column:
    """The matrix of the camera in a row's columns, pitch to image, as an array."""
    at = [F.col(c) for c in ("x", "y", "height", "yaw", "tilt", "roll")]
    return F.array(*camera.camera_homography(*at, F.log("focal"), F.lit(1920.0), F.lit(1080.0)))


def view_back() -> Column:
    """The same, image to pitch; the first matrix is computed once a row, as a lambda's variable."""

    def back(h: Column) -> Column:
        m = [h[i] for i in range(9)]
        return F.array(*[v * F.signum(geometry.determinant(m)) for v in geometry.adjugate(m)])

    return F.element_at(F.transform(F.array(view()), back), 1)


def keyframes(spark, sf, shift: Column | None = None) -> DataFrame:
    """One keyframe a user: clicks where the camera shows their events' places; shift: pixels that a click (place, n) is off."""
    e = events(spark, sf).groupBy(F.col("user_id").alias("u"), "kind", F.floor(F.col("day") / 7).alias("week"))
    clicks = e.agg(F.min(F.struct("us", F.col("event_id").alias("id"), (F.col("v") % 106).cast("double").alias("px"), (F.floor(F.col("us") / 1_000_000) % 69).cast("double").alias("py"))).alias("m"))
    # matrices are made below the join, once a camera and not in each click's every coordinate
    c = clicks.select("u", "m.id", "m.px", "m.py").join(cameras(spark, sf).withColumn("h", view()), "u")
    ix, iy, w = geometry.projected([F.col("h")[i] for i in range(9)], F.col("px"), F.col("py"))
    away = F.cos("yaw") * F.cos("tilt") * (F.col("px") - F.col("x")) + F.sin("yaw") * F.cos("tilt") * (F.col("py") - F.col("y")) + F.sin("tilt") * F.col("height")
    c = c.where(away > 1).withColumn("ix", ix).withColumn("iy", iy).where(F.col("ix").between(-400, 2320) & F.col("iy").between(-400, 1480))
    g = c.groupBy("u", "x", "y", "height", "yaw", "tilt", "focal").agg(F.sort_array(F.collect_list(F.struct("id", "ix", "iy", "px", "py"))).alias("cs"))
    none = F.lit(None).cast("double")
    off = (lambda i: F.lit(0.0)) if shift is None else (lambda i: F.when(i == shift, 260.0).otherwise(0.0))
    click = lambda p, i: F.struct((p["ix"] + off(i)).alias("x"), p["iy"].alias("y"), p["px"].alias("px"), p["py"].alias("py"), *[none.alias(n) for n in ("ax", "ay", "bx", "by", "up", "zoom")])
    prior = F.struct("x", "y", "height", "focal", F.lit(3.0).alias("uncertain"), none.alias("yaw"))
    return g.select("u", F.size("cs").cast("long").alias("n"), F.transform("cs", click).alias("clicks"), prior.alias("prior"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), "yaw", "tilt")


@query(CAMERAS_SQL + """ SELECT u, n, 'camera' AS model, true AS fits, CAST(max(x) AS DOUBLE) AS x, CAST(max(y) AS DOUBLE) AS y, CAST(max(height) AS DOUBLE) AS height, max(round(degrees(yaw), 1)) AS yaw, max(round(degrees(tilt), 1)) AS tilt
 FROM k WHERE n >= 4 GROUP BY u, n""")
def camera_fits(spark, sf):
    """Cameras fitted to the clicks of each keyframe of four clicks or more; the planted ones come back. [STA-10, STA-11, STA-17, STA-18, SFN-32]"""
    f = calibration.fit_keyframes(keyframes(spark, sf).where("n >= 4"), search=False)
    c = lambda i: F.col("fit.camera")[i]
    turn = lambda i: F.round(geometry.wrapped(F.degrees(c(i))), 1)
    return f.select("u", "n", F.when(F.col("fit.camera").isNotNull(), "camera").alias("model"), "fit.fits", *[F.round(c(i), 1).alias(n) for i, n in enumerate(("x", "y", "height"))], turn(3).alias("yaw"), turn(4).alias("tilt"))


@query(CAMERAS_SQL + " SELECT u, n, CAST(u % n AS INTEGER) AS suspect FROM k WHERE n >= 8 GROUP BY u, n")
def lone_clicks(spark, sf):
    """In each keyframe of eight clicks or more one is off: it is named, from fits without each click in turn. [STA-12, SFN-24]"""
    f = calibration.fit_keyframes(keyframes(spark, sf, F.col("u") % F.size("cs")).where("n >= 8"))
    return f.select("u", "n", "fit.suspect")


@query(CAMERAS_SQL + """ SELECT u, CAST(round(x) AS BIGINT) AS x, CAST(round(y) AS BIGINT) AS y, CAST(round(height) AS BIGINT) AS height, CAST(round(focal / 5) AS BIGINT) AS focal, true AS exact FROM cam""")
def cameras_from_views(spark, sf):
    """The camera behind each user's image-to-pitch matrix. [STA-11]"""
    c = cameras(spark, sf).withColumn("h", view_back()).select("u", "h", F.lit(1920).alias("width"), F.lit(1080).alias("height"))
    f = calibration.inverse_cameras(c)
    at = lambda i: F.col("seen_by.camera")[i]
    return f.select("u", *[F.round(at(i)).cast("long").alias(n) for i, n in enumerate(("x", "y", "height"))], F.round(F.exp(at(6)) / 5).cast("long").alias("focal"), (F.col("seen_by.error") < 1).alias("exact"))


@query(CAMERAS_SQL + """ SELECT u, true AS ok, CAST(0 AS DOUBLE) AS off, false AS ok_elsewhere FROM cam""")
def views_at_stations(spark, sf):
    """Each user's view fits a camera at their place that looks elsewhere, and none forty metres away. [CAL-07]"""
    c = cameras(spark, sf)
    station = F.array("x", "y", "height", F.col("yaw") + 0.2, F.lit(0.0), F.lit(0.0), F.log(F.col("focal") * 0.8))
    c = c.select("u", view_back().alias("h"), station.alias("here"), F.lit(1920).alias("width"), F.lit(1080).alias("height"))
    away = F.transform("here", lambda v, i: F.when(i == 0, v - 40).when(i == 2, v + 5).otherwise(v))
    c = calibration.plausible(c, station="here").withColumn("there", away)
    c = calibration.plausible(c, station="there", result="elsewhere")
    return c.select("u", "view.ok", F.round("view.error", 0).alias("off"), F.col("elsewhere.ok").alias("ok_elsewhere"))


#: Users of one kind's consecutive events are linked; a link costs one to three.
LINKS_SQL = """, o AS (SELECT kind, user_id AS src, v, lead(user_id) OVER (PARTITION BY kind, day ORDER BY us, event_id) AS dst FROM b),
 e AS (SELECT kind, src, dst, min(1 + v % 3) AS cost FROM o WHERE dst IS NOT NULL GROUP BY ALL),
 n AS (SELECT kind, user_id, count(*) AS n FROM b GROUP BY ALL), f AS (SELECT kind, arg_max(user_id, struct_pack(n := n, u := -user_id)) AS node FROM n GROUP BY kind)"""


def links(spark, sf) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql.window import Window

    e = events(spark, sf)
    nxt = F.lead("user_id").over(Window.partitionBy("kind", "day").orderBy("us", "event_id"))
    edges = e.select("kind", F.col("user_id").alias("src"), nxt.alias("dst"), "v").where("dst is not null").groupBy("kind", "src", "dst").agg(F.min(1 + F.col("v") % 3).alias("cost"))
    most = e.groupBy("kind", "user_id").count().groupBy("kind").agg(F.max_by("user_id", F.struct("count", -F.col("user_id"))).alias("node"))
    return edges, most


@query(EVENTS_SQL.replace("WITH", "WITH RECURSIVE", 1) + LINKS_SQL + """, r(kind, node, cost) AS (SELECT kind, node, CAST(0 AS BIGINT) FROM f
 UNION SELECT e.kind, e.dst, r.cost + e.cost FROM r JOIN e ON r.kind = e.kind AND r.node = e.src WHERE r.cost + e.cost <= 20)
 SELECT kind, node, min(cost) AS cost FROM r GROUP BY kind, node""", events=False)
def relay_paths(spark, sf):
    """Paths of least cost from the busiest user of each kind, up to a cost of 20. [STA-16]"""
    edges, seeds = links(spark, sf)
    return rounds.shortest_paths(edges, seeds.withColumn("cost", F.lit(0.0)), ["kind"], reach=20.0).select("kind", "node", F.col("cost").cast("long").alias("cost"))


@query(EVENTS_SQL.replace("WITH", "WITH RECURSIVE", 1) + LINKS_SQL + """, r(kind, node, round) AS (SELECT kind, node, 0 FROM f
 UNION SELECT e.kind, e.dst, r.round + 1 FROM r JOIN e ON r.kind = e.kind AND r.node = e.src WHERE r.round < 40)
 SELECT kind, node, min(round) AS round FROM r GROUP BY kind, node""", events=False)
def reached_in_rounds(spark, sf):
    """The round in which each user is reached from the busiest one of its kind. [CAL-06]"""
    edges, seeds = links(spark, sf)

    def step(added, _):
        near = added.join(edges.withColumnRenamed("src", "node"), ["kind", "node"])
        return near.groupBy("kind", F.col("dst").alias("node")).agg((F.min("round") + 1).alias("round"))

    return rounds.fix_point(seeds.withColumn("round", F.lit(0)), step, ["kind", "node"])
