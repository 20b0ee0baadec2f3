"""What users look at: positions per frame, boxes, the ball's path, overlays. Tables as in sources/schemas.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions import geometry
from trackmill.operators import timejoins


def between(df: DataFrame, t0: float, t1: float, time: str = "t") -> DataFrame:
    """Rows of a time range, both ends in. [FLT-01]"""
    return df.where(F.col(time).between(t0, t1))


def teams(tracks: DataFrame, players: DataFrame) -> DataFrame:
    """Tracks with the team of the linked player, else their own, and the entity they are counted under. [JOI-02, PRJ-04, STA-04]"""
    p = players.select(F.col("id").alias("player_id"), F.col("team").alias("__team"), F.col("name").alias("player"))
    entity = F.coalesce(F.concat(F.lit("p"), F.nullif("player_id", F.lit(0)).cast("string")), F.concat(F.lit("c"), F.col("clip_id"), F.lit("t"), F.col("track_id")))
    return tracks.join(p, "player_id", "left").withColumn("team", F.coalesce("__team", "team")).withColumn("entity", entity).drop("__team")


def counted(tracks: DataFrame) -> DataFrame:
    """Tracks that statistics count: no referees, unless linked to a player. [FLT-06]"""
    return tracks.where(F.col("player_id").isNotNull() | ~F.coalesce(F.col("team") == 2, F.lit(False)))


def analysed(clips: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Clips that are done and have an accepted keyframe. [FLT-07, SRC-14]"""
    return clips.where("status = 'done'").join(keyframes.where("accepted").select(F.col("clip_id").alias("id")).distinct(), "id", "left_semi")


def bracketed(frames: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Frames (clip_id, idx, t, a: motion to the reference frame) with the image-to-pitch matrices h0, h1 that the keyframes (clip_id, t, h, a) before and
    after give, and the weight of the later one. [WIN-19, WIN-20, JOI-09, QRY-15]

    A keyframe's matrix is carried to a frame by the motion between them: h times the inverse of its motion times the frame's.
    """
    key = F.struct("t", "h", "a")
    both = frames.select("clip_id", "idx", "t", "a", F.lit(1).alias("side")).unionByName(keyframes.select("clip_id", F.lit(None).cast("int").alias("idx"), "t", F.lit(0).alias("side"), "a", key.alias("k")), allowMissingColumns=True)
    back = F.last("k", True).over(Window.partitionBy("clip_id").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("k", True).over(Window.partitionBy("clip_id").orderBy("t", F.desc("side")).rowsBetween(0, Window.unboundedFollowing))
    f = both.withColumn("b", back).withColumn("n", ahead).where("side = 1")

    def carried(k: str, other: str) -> Column:
        pick = lambda name: [F.coalesce(F.col(f"{k}.{name}"), F.col(f"{other}.{name}"))[i] for i in range(9)]
        m = geometry.product(geometry.product(pick("h"), geometry.adjugate(pick("a"))), [F.col("a")[i] for i in range(9)])
        sign = F.signum(geometry.determinant(pick("a")))
        return F.array(*[x * sign for x in m])

    span = F.col("n.t") - F.col("b.t")
    weight = F.when(F.col("b").isNull() | F.col("n").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("t") - F.col("b.t"), span), F.lit(0.0)))
    return f.where("b is not null or n is not null").select("clip_id", "idx", "t", carried("b", "n").alias("h0"), carried("n", "b").alias("h1"), weight.alias("weight"))


def warped(points: DataFrame, motion: DataFrame) -> DataFrame:
    """Points (clip_id, idx_from, idx_to, x, y, ...) with `wx`, `wy`: where the same place is in the other frame's image, by the camera's motion (clip_id, idx, a). [QRY-15]"""
    side = lambda k: motion.select("clip_id", F.col("idx").alias(f"idx_{k}"), F.col("a").alias(f"a_{k}"))
    j = points.join(side("from"), ["clip_id", "idx_from"], "left").join(side("to"), ["clip_id", "idx_to"], "left")
    m = geometry.product(geometry.adjugate([F.col("a_to")[i] for i in range(9)]), [F.col("a_from")[i] for i in range(9)])
    wx, wy, _ = geometry.projected(m, F.col("x"), F.col("y"))
    return j.withColumn("wx", wx).withColumn("wy", wy).drop("a_from", "a_to")


def on_pitch(detections: DataFrame, frame_h: DataFrame) -> DataFrame:
    """Detections with their foot's place on the pitch, from the frame's two matrices; null where both see it behind the camera. [JOI-01, PRJ-01, SFN-04, WIN-19]"""
    d = detections.join(frame_h, ["clip_id", "idx"])
    fx, fy = geometry.foot(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    at = lambda h: geometry.projected([F.col(h)[i] for i in range(9)], fx, fy)
    (ax, ay, aw), (bx, by, bw) = at("h0"), at("h1")
    weight = F.when((aw > 0) & (bw > 0), F.col("weight")).when(aw > 0, 0.0).when(bw > 0, 1.0)
    x, y = geometry.blended((ax, ay), (bx, by), weight)
    seen = weight.isNotNull()
    return d.withColumn("x", F.when(seen, x)).withColumn("y", F.when(seen, y)).drop("h0", "h1", "weight")


def minimap(frames: DataFrame, positions: DataFrame, ball: DataFrame, valid: DataFrame, t0: float, t1: float) -> DataFrame:
    """Per frame of a range the players (array of structs x, y, team, entity) and the ball. [QRY-02, JOI-01]"""
    p = positions.where("x is not null").join(valid.select("clip_id", "entity").distinct(), ["clip_id", "entity"], "left_semi")
    p = p.groupBy("clip_id", "idx").agg(F.array_sort(F.collect_list(F.struct("entity", "team", F.round("x", 2).alias("x"), F.round("y", 2).alias("y")))).alias("players"))
    b = ball.where("x is not null").groupBy("clip_id", "idx").agg(F.min(F.struct(F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))).alias("ball"))
    f = between(frames, t0, t1).join(p, ["clip_id", "idx"], "left").join(b, ["clip_id", "idx"], "left")
    none = F.array().cast("array<struct<entity:string,team:int,x:double,y:double>>")
    return f.select("clip_id", "idx", F.round("t", 3).alias("t"), F.coalesce(F.col("players").cast("array<struct<entity:string,team:int,x:double,y:double>>"), none).alias("players"), "ball")


def boxes(frames: DataFrame, detections: DataFrame, t0: float, t1: float) -> DataFrame:
    """Boxes of a time range with their time. [QRY-03, FLT-01]"""
    return between(frames, t0, t1).join(detections, ["clip_id", "idx"]).select("clip_id", "idx", "t", "track_id", "x1", "y1", "x2", "y2")


def shown_boxes(detections: DataFrame, at: DataFrame, reach: float = 0.5) -> DataFrame:
    """For each asked time (clip_id, asked) all boxes of the latest frame at or before it, if less than `reach` old. [JOI-25, JOI-26]"""
    t = detections.select("clip_id", "t").distinct().withColumn("side", F.lit(0)).unionByName(at.select("clip_id", F.col("asked").alias("t"), F.lit(1).alias("side")))
    last = F.last(F.when(F.col("side") == 0, F.col("t")), True).over(Window.partitionBy("clip_id").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0))
    found = t.withColumn("frame_t", last).where((F.col("side") == 1) & (F.col("t") - F.col("frame_t") < reach)).select("clip_id", F.col("t").alias("asked"), "frame_t").distinct()
    return found.join(detections.withColumnRenamed("t", "frame_t"), ["clip_id", "frame_t"])


def box_at(series: DataFrame, at: DataFrame, max_gap: float = 0.6, near: float = 0.15) -> DataFrame:
    """For each asked time the box between the samples around it (at most `max_gap` apart), else the nearest sample within `near`. [WIN-21]"""
    names = ["x1", "y1", "x2", "y2"]
    s = F.struct("t", *names)
    both = series.select("clip_id", "t", F.lit(0).alias("side"), s.alias("s")).unionByName(at.select("clip_id", F.col("asked").alias("t"), F.lit(1).alias("side")), allowMissingColumns=True)
    before = F.last("s", True).over(Window.partitionBy("clip_id").orderBy("t", F.desc("side")).rowsBetween(Window.unboundedPreceding, 0))  # strictly before
    after = F.first("s", True).over(Window.partitionBy("clip_id").orderBy("t", F.desc("side")).rowsBetween(0, Window.unboundedFollowing))
    f = both.withColumn("p", before).withColumn("n", after).where("side = 1").select("clip_id", F.col("t").alias("asked"), "p", "n")
    span, w = F.col("n.t") - F.col("p.t"), (F.col("asked") - F.col("p.t")) / F.greatest(F.lit(1e-6), F.col("n.t") - F.col("p.t"))
    dp, dn = F.coalesce(F.col("asked") - F.col("p.t"), F.lit(float("inf"))), F.coalesce(F.col("n.t") - F.col("asked"), F.lit(float("inf")))
    near_one = F.when(dp <= dn, F.when(dp <= near, F.col("p"))).when(dn <= near, F.col("n"))
    mixed = F.struct(*[((1 - w) * F.col(f"p.{c}") + w * F.col(f"n.{c}")).alias(c) for c in names])
    box = F.when(span <= max_gap, mixed).otherwise(F.struct(*[near_one[c].alias(c) for c in names]))
    return f.withColumn("box", box).where("box.x1 is not null").select("clip_id", "asked", "box.*")


def spotlight(detections: DataFrame, frames: DataFrame, tracks: DataFrame, player: int, t0: float, t1: float) -> DataFrame:
    """A player's box at each time of a range, the tallest of several. [JOI-04, JOI-03]"""
    own = tracks.where(F.col("player_id") == player).select("clip_id", "track_id")
    d = boxes(frames, detections, t0, t1).join(own, ["clip_id", "track_id"], "left_semi").withColumn("h", F.col("y2") - F.col("y1"))
    w = Window.partitionBy("clip_id", "t").orderBy(F.desc("h"), "track_id")
    return d.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "h")


def clicked(boxes_: DataFrame, x: float, y: float) -> DataFrame:
    """The narrowest box of each frame that holds a point. [FLT-16]"""
    w = Window.partitionBy("clip_id", "idx").orderBy(F.col("x2") - F.col("x1"), "track_id")
    held = boxes_.where((F.col("x1") <= x) & (F.col("x2") >= x) & (F.col("y1") <= y) & (F.col("y2") >= y))
    return held.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def ball_path(frames: DataFrame, ball: DataFrame, manual: DataFrame, reach: float = 0.08, max_gap: float = 1.0, max_speed: float = 35.0) -> DataFrame:
    """The ball's place per frame and where it comes from: found, by hand, or filled in over gaps of at most a second. [QRY-05, SET-01, JOI-08, JOI-24, WIN-09, PRJ-08]

    Ball and manual places are in metres or pixels alike. A manual row counts for the nearest frame within 0.08 s; one without a
    place says that there is no ball, so nothing is filled in there.
    """
    us = F.round(F.col("t") * 1_000_000).cast("long").alias("us")
    at = manual.select("clip_id", "t", us, F.struct("x", "y").alias("m"))
    near = timejoins.as_of(at, frames.select("clip_id", us, (-F.col("idx")).alias("i")), ["clip_id"], "us", "i", "nearest", round(reach * 1_000_000), "frame")
    by_hand = near.where("frame is not null").groupBy("clip_id", (-F.col("frame.v")).alias("idx")).agg(F.max_by("m", "t").alias("m"))
    found = ball.groupBy("clip_id", "idx").agg(F.max_by(F.struct("x", "y"), F.struct("conf", "x")).alias("f"))
    rows = frames.join(found, ["clip_id", "idx"], "left").join(by_hand, ["clip_id", "idx"], "left")
    hand = F.col("m").isNotNull()
    rows = rows.withColumn("p", F.when(hand, F.when(F.col("m.x").isNotNull(), F.col("m"))).otherwise(F.col("f"))).withColumn("blocked", hand & F.col("m.x").isNull())
    kind = F.when(F.col("p").isNull(), None).when(hand, "hand").otherwise("found")
    s = F.when(F.col("p").isNotNull(), F.struct("t", "p.x", "p.y"))
    w = Window.partitionBy("clip_id").orderBy("t", "idx")
    rows = rows.withColumn("b", F.last(s, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.first(s, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    gap = F.col("n.t") - F.col("b.t")
    u = F.try_divide(F.col("t") - F.col("b.t"), gap)
    ok = F.col("p").isNull() & ~F.col("blocked") & (gap <= max_gap) & (F.hypot(F.col("n.x") - F.col("b.x"), F.col("n.y") - F.col("b.y")) <= max_speed * gap)
    pick = lambda c: F.coalesce(F.col(f"p.{c}"), F.when(ok, F.col(f"b.{c}") * (1 - u) + F.col(f"n.{c}") * u)).alias(c)
    return rows.select("clip_id", "idx", "t", pick("x"), pick("y"), F.coalesce(kind, F.lit("filled")).alias("kind")).where("x is not null")


def moments(moments_: DataFrame, clips: DataFrame) -> DataFrame:
    """Moments of matches in order of clip and start, their players and drawings from JSON: a list, or one number of old rows. [SRC-13, SRC-06]"""
    c = clips.select(F.col("id").alias("clip_id"), "match_id", "order_idx")
    players = F.coalesce(F.from_json("players", "array<bigint>"), F.when(F.col("players").try_cast("bigint").isNotNull(), F.array(F.col("players").try_cast("bigint"))), F.array().cast("array<bigint>"))
    return moments_.join(c, "clip_id").withColumn("players", players).orderBy("match_id", "order_idx", "t_start", "id")


def pass_arrows(network: DataFrame, statistics: DataFrame) -> DataFrame:
    """Pass counts (from_owner, to_owner, n) with both players' mean places, the passer's team and a width by the largest count. [JOI-29, AGG-27]"""
    place = lambda k: statistics.select(F.col("entity").alias(k), F.col("avg_x").alias(f"{k}_x"), F.col("avg_y").alias(f"{k}_y"), *([F.col("team")] if k == "from_owner" else []))
    most = F.max("n").over(Window.partitionBy(F.lit(1)))  # at most one row a pair of players of a match
    return network.join(place("from_owner"), "from_owner").join(place("to_owner"), "to_owner").withColumn("width", 1 + 7 * F.col("n") / most)


def with_shots(statistics: DataFrame, shots: DataFrame) -> DataFrame:
    """Player rows with their confirmed shots, shots on target and goals, none counting 0. [JOI-28, AGG-17]"""
    s = shots.where("status = 'confirmed' and player_id is not null").groupBy(F.concat(F.lit("p"), F.col("player_id")).alias("entity")).agg(F.count("*").alias("shots"), F.count_if("on_target").alias("on_target"), F.count_if("goal").alias("goals"))
    return statistics.join(s, "entity", "left").fillna(0, ["shots", "on_target", "goals"])


def visible_landmarks(landmarks: DataFrame, frame_h: DataFrame, width: float, height: float, samples: int = 41) -> DataFrame:
    """Places of pitch lines (name, ax, ay, bx, by) in an image (pitch-to-image matrix h): of 41 samples a line the visible ones, thinned to the quarters. [SFN-35, SFN-36]"""
    s = landmarks.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("u", F.col("i") / (samples - 1))
    j = s.join(F.broadcast(frame_h.select("clip_id", "idx", "h")))  # a handful of asked frames by some fifty lines
    px, py = F.col("ax") + (F.col("bx") - F.col("ax")) * F.col("u"), F.col("ay") + (F.col("by") - F.col("ay")) * F.col("u")
    x, y, w = geometry.projected([F.col("h")[k] for k in range(9)], px, py)
    seen = j.select("clip_id", "idx", "name", "i", px.alias("px"), py.alias("py"), F.when(w > 0, x).alias("x"), F.when(w > 0, y).alias("y")).where(F.col("x").between(0, width) & F.col("y").between(0, height))
    order = Window.partitionBy("clip_id", "idx", "name").orderBy("i")
    n = F.count("*").over(Window.partitionBy("clip_id", "idx", "name"))
    k = F.row_number().over(order) - 1
    return seen.withColumn("k", k).withColumn("n", n).where(F.col("k").isin(0) | (F.col("k") == F.floor((F.col("n") - 1) / 4)) | (F.col("k") == F.floor((F.col("n") - 1) / 2)) | (F.col("k") == F.floor(3 * (F.col("n") - 1) / 4)) | (F.col("k") == F.col("n") - 1)).drop("k", "n", "i")
