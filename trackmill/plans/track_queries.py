"""Tracks, places and cameras on the driver's tables, through the library's own operators: a user is a track, a day a clip, an event a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmill.operators import scans, spatial
from trackmill.plans import linking, match, order, views
from trackmill.plans.registry import events, query

#: Frames of each day and user: number, hours as time, a box, a place on the pitch that is sometimes unknown, the camera's shift.
FRAMES_SQL = """, f AS (SELECT day, user_id, row_number() OVER (PARTITION BY day, user_id ORDER BY us, event_id) - 1 AS idx, us / 3600000000.0::DOUBLE AS t,
  CAST(v % 40 AS DOUBLE) AS x1, CAST(v % 40 + 10 AS DOUBLE) AS x2, CAST(5 AS DOUBLE) AS y1, CAST(5 + 80 + v % 7 * 10 AS DOUBLE) AS y2,
  CASE WHEN v % 5 <> 0 THEN CAST(v % 105 AS DOUBLE) END AS x, CAST(v % 68 AS DOUBLE) AS y, v % 9 - 4 AS shift, event_id FROM b)"""


def frames(spark, sf) -> DataFrame:
    w = Window.partitionBy("day", "user_id").orderBy("us", "event_id")
    v = F.col("v")
    return events(spark, sf).select(
        F.col("day").alias("clip_id"), F.col("user_id").alias("track_id"), (F.row_number().over(w) - 1).cast("long").alias("idx"), (F.col("us") / 3_600_000_000).alias("t"),
        (v % 40).cast("double").alias("x1"), F.lit(5.0).alias("y1"), (v % 40 + 10).cast("double").alias("x2"), (5 + 80 + v % 7 * 10).cast("double").alias("y2"),
        F.when(v % 5 != 0, (v % 105).cast("double")).alias("x"), (v % 68).cast("double").alias("y"), (v % 9 - 4).cast("double").alias("shift"), "event_id",
    )


def shifts(df: DataFrame) -> DataFrame:
    """Motion to the reference frame: a shift to the side."""
    one = [F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)]
    return df.withColumn("a", F.array(*one[:2], F.col("shift"), *one[3:]))


@query(FRAMES_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY day, user_id ORDER BY t, idx) AS u, row_number() OVER (PARTITION BY day, user_id ORDER BY t DESC, idx DESC) AS d FROM f)
 SELECT day AS clip_id, user_id AS track_id, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx, max(CASE WHEN u = 1 THEN (x1 + x2) / 2 END) AS fx, max(CASE WHEN d = 1 THEN y2 END) AS fy,
  arg_min(x, idx) FILTER (WHERE x IS NOT NULL) AS x0, arg_max(x, idx) FILTER (WHERE x IS NOT NULL) AS x1, quantile_cont(y2 - y1, 0.5) FILTER (WHERE u <= 5) AS h0, quantile_cont(y2 - y1, 0.5) FILTER (WHERE d <= 5) AS h1
 FROM r GROUP BY day, user_id""")
def track_summaries(spark, sf):
    """What is known of each track, from mergeable states of its parts. [AGG-12, AGG-31, WIN-18]"""
    s = linking.summaries(frames(spark, sf))
    return s.select("clip_id", "track_id", "n", F.col("first.idx").alias("first_idx"), F.col("last.idx").alias("last_idx"), F.col("first.fx").alias("fx"), F.col("last.fy").alias("fy"), F.col("p0.x").alias("x0"), F.col("p1.x").alias("x1"), "h0", "h1")


@query(FRAMES_SQL + """ SELECT day AS clip_id, user_id AS track_id, idx, (x1 + x2) / 2 + shift AS ax, y2 AS ay FROM f""")
def feet_in_reference(spark, sf):
    """Feet in the image of the clip's reference frame, the camera's motion taken out. [QRY-16, SFN-01]"""
    f = shifts(frames(spark, sf)).withColumn("clip_id", F.concat_ws("/", "clip_id", "track_id"))
    a = linking.anchored_feet(f.select("clip_id", "track_id", "idx", "x1", "y1", "x2", "y2"), f.select("clip_id", "idx", "a"))
    return a.select(F.split("clip_id", "/")[0].cast("long").alias("clip_id"), "track_id", "idx", "ax", "ay")


@query(FRAMES_SQL + """ SELECT g.day AS clip_id, g.user_id AS track_id, g.idx, CAST(100 + g.shift - h.shift AS DOUBLE) AS wx, CAST(50 AS DOUBLE) AS wy FROM f g JOIN f h ON h.day = g.day AND h.user_id = g.user_id AND h.idx = g.idx + 1""")
def points_of_next_frame(spark, sf):
    """Where a point is in the next frame's image. [QRY-15, SFN-02]"""
    f = shifts(frames(spark, sf)).withColumn("clip_id", F.concat_ws("/", "clip_id", "track_id"))
    asked = f.select("clip_id", "track_id", F.col("idx").alias("idx_from"), (F.col("idx") + 1).alias("idx_to"), F.lit(100.0).alias("x"), F.lit(50.0).alias("y"))
    w = views.warped(asked, f.select("clip_id", "idx", "a")).where("wx is not null")
    return w.select(F.split("clip_id", "/")[0].cast("long").alias("clip_id"), "track_id", F.col("idx_from").alias("idx"), "wx", "wy")


@query(FRAMES_SQL + """ SELECT day AS clip_id, user_id AS track_id, idx, CAST(sum(shift) OVER (PARTITION BY day, user_id ORDER BY idx) AS DOUBLE) AS moved FROM f""")
def motion_since_start(spark, sf):
    """The camera's motion since a clip's beginning: running products of matrices, in blocks. [WIN-20]"""
    p = scans.prefix_products(shifts(frames(spark, sf)).select("clip_id", "track_id", "idx", "a"), ["clip_id", "track_id"], "idx", "a", block=4)
    return p.select("clip_id", "track_id", "idx", F.col("product")[2].alias("moved"))


@query(FRAMES_SQL + """ SELECT day AS clip_id, user_id AS track_id, idx, ((x1 + x2) / 2 + 3) * (2 + user_id % 3) AS x, (y2 + 1) * (2 + user_id % 3) AS y FROM f""")
def feet_on_pitch(spark, sf):
    """Places on the pitch of the boxes' feet, by the matrices of their frame. [JOI-01, PRJ-01, SFN-04]"""
    f = frames(spark, sf).withColumn("clip_id", F.concat_ws("/", "clip_id", "track_id"))
    k, zero = (2 + F.col("track_id") % 3).cast("double"), F.lit(0.0)
    h = F.array(k, zero, 3 * k, zero, k, k, zero, zero, F.lit(1.0))
    p = views.on_pitch(f.select("clip_id", "track_id", "idx", "x1", "y1", "x2", "y2"), f.select("clip_id", "idx", h.alias("h0"), h.alias("h1"), F.lit(0.25).alias("weight")))
    return p.select(F.split("clip_id", "/")[0].cast("long").alias("clip_id"), "track_id", "idx", "x", "y")


@query(FRAMES_SQL + """, j AS (SELECT g.day, g.user_id, g.idx, arg_min(struct_pack(t := h.t, x := (h.x1 + h.x2) / 2, y := h.y2), h.t) AS n, any_value(g.t) AS t, any_value((g.x1 + g.x2) / 2) AS x, any_value(g.y2) AS y
  FROM f g JOIN f h ON h.day = g.day AND h.user_id = g.user_id AND h.t >= g.t + 1 GROUP BY g.day, g.user_id, g.idx),
 h AS (SELECT day, user_id, quantile_cont(y2 - y1, 0.5) AS h FROM f GROUP BY day, user_id HAVING count(*) >= 8 AND max(t) - min(t) >= 1.5),
 s AS (SELECT day, user_id, sqrt((n.x - x) ** 2 + (n.y - y) ** 2) / (n.t - t) / h AS speed FROM j JOIN h USING (day, user_id))
 SELECT day AS clip_id, user_id AS entity, avg(CASE WHEN speed < 0.3 THEN 1 ELSE 0 END) AS still FROM s GROUP BY day, user_id HAVING count(*) >= 3 AND quantile_cont(speed, 0.5) < 0.15""")
def still_tracks(spark, sf):
    """The share of its time that each track stands still. [AGG-10, AGG-11, AGG-32, JOI-06, SFN-02]"""
    one = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)])
    f = frames(spark, sf).select("clip_id", F.col("track_id").alias("entity"), "t", "idx", ((F.col("x1") + F.col("x2")) / 2).alias("fx"), F.col("y2").alias("fy"), (F.col("y2") - F.col("y1")).alias("height"), one.alias("a"))
    return match.stillness(f)


@query(""", p AS (SELECT user_id AS id, 52.0 + max(v) % 400 / 1e5 AS lat, 5.0 + min(event_id) % 300 / 1e5 AS lon FROM b GROUP BY user_id),
 d AS (SELECT a.id, b.id AS other, sqrt((radians(b.lon - a.lon) * 6371000 * cos(radians((a.lat + b.lat) / 2))) ** 2 + (radians(b.lat - a.lat) * 6371000) ** 2) AS m FROM p a JOIN p b ON a.id <> b.id)
 SELECT id, other FROM d WHERE m <= 30""")
def places_within_reach(spark, sf):
    """Users whose places are at most thirty metres apart. [JOI-17, SFN-07]"""
    p = events(spark, sf).groupBy(F.col("user_id").alias("id")).agg((52.0 + F.max("v") % 400 / 1e5).alias("lat"), (5.0 + F.min("event_id") % 300 / 1e5).alias("lon"))
    return spatial.within(p, p.withColumnRenamed("id", "other"), 30.0, "id", "other").where("id <> other").select("id", "other")


@query(""", p AS (SELECT user_id AS id, 52.0 + max(v) % 400 / 1e5 AS lat, 5.0 + min(event_id) % 300 / 1e5 AS lon FROM b GROUP BY user_id),
 d AS (SELECT a.id, b.id AS other, sqrt((radians(b.lon - a.lon) * 6371000 * cos(radians((a.lat + b.lat) / 2))) ** 2 + (radians(b.lat - a.lat) * 6371000) ** 2) AS m FROM p a JOIN p b ON a.id % 2 = 0 AND b.id % 2 = 1)
 SELECT id, arg_min(other, struct_pack(m := round(m, 6), o := other)) AS other FROM d WHERE m <= 150 GROUP BY id""")
def nearest_known_place(spark, sf):
    """The nearest known place within 150 metres of each new one. [JOI-17, STA-14]"""
    p = events(spark, sf).groupBy(F.col("user_id").alias("id")).agg((52.0 + F.max("v") % 400 / 1e5).alias("lat"), (5.0 + F.min("event_id") % 300 / 1e5).alias("lon"))
    return spatial.nearest_within(p.where("id % 2 = 0"), p.where("id % 2 = 1").withColumnRenamed("id", "other"), 150.0, "id", "other", digits=6).select("id", "other")


@query(""", c AS (SELECT event_id AS id, user_id AS m, CASE WHEN v % 11 <> 0 THEN us / 1e6 END AS s, CAST(v % 7200 AS DOUBLE) AS d FROM b),
 g AS (SELECT *, s - (lag(s) OVER (PARTITION BY m ORDER BY s, id) + lag(d) OVER (PARTITION BY m ORDER BY s, id)) AS gap FROM c WHERE s IS NOT NULL),
 x AS (SELECT m, arg_max(struct_pack(id := id, gap := gap), struct_pack(gap := gap, t := -s, i := -id)) AS cut FROM g WHERE gap >= 300 GROUP BY m),
 n AS (SELECT m, count(*) FILTER (WHERE s IS NULL) AS without_time FROM c GROUP BY m)
 SELECT n.m AS match_id, cut.id AS second_clip, CAST(round_even(cut.gap / 60, 0) AS INTEGER) AS gap_minutes, n.without_time FROM n LEFT JOIN x ON x.m = n.m""")
def guessed_halves(spark, sf):
    """The clip that likely begins each match's second half: after its longest pause of five minutes or more. [WIN-16, QRY-09]"""
    v = F.col("v")
    c = events(spark, sf).select(F.col("event_id").alias("id"), F.col("user_id").alias("match_id"), F.when(v % 11 != 0, F.col("us") / 1e6).alias("rec_start"), (v % 7200).cast("double").alias("duration"), F.col("event_id").alias("order_idx"))
    m = c.select(F.col("match_id").alias("id"), *[F.lit(None).cast("double").alias(x) for x in ("kickoff", "kickoff2")], F.lit(None).cast("int").alias("half_length")).distinct()
    return order.guessed(c, m).select("match_id", "second_clip", "gap_minutes", "without_time")
