"""Match queries over projected positions: movement, heat map, possession, passes, statistics.

Input `positions`: clip_id, idx, t, entity, team, x, y (metres; null where unknown), fps. Input `ball`:
clip_id, idx, t, x, y. All series are per clip, so windows partition by clip and entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions import geometry
from trackmill.operators import sequences as s

#: Thresholds of the domain (fixed values): m/s, s, m.
MAX_SPEED, SPRINT_SPEED, SPRINT_S, RADIUS, PASS_GAP, MERGE_GAP, CUT_GAP = 11.0, 25 / 3.6, 1.0, 2.0, 5.0, 1.0, 0.6


def smoothed_positions(positions: DataFrame) -> DataFrame:
    """Segments without a pause over 0.6 s, smoothed over five samples. [WIN-01, WIN-02]"""
    cut = s.segments(positions.where("x is not null"), ["clip_id", "entity"], "t", "idx", CUT_GAP)
    keys = ["clip_id", "entity", "segment"]
    both = s.smoothed(s.smoothed(cut, keys, ["t", "idx"], "x", name="sx"), keys, ["t", "idx"], "y", name="sy")
    return both.withColumn("x", F.col("sx_sum") / F.col("sx_n")).withColumn("y", F.col("sy_sum") / F.col("sy_n")).drop("sx_sum", "sx_n", "sy_sum", "sy_n")


def movement(positions: DataFrame) -> DataFrame:
    """Distance, top speed, seconds and sprints of each entity; steps over 11 m/s count for the time alone. [AGG-01, WIN-03, WIN-04]"""
    keys = ["clip_id", "entity", "segment"]
    d = s.steps(smoothed_positions(positions), keys, ["t", "idx"], "t", ["x", "y"])
    d = d.withColumn("step", F.hypot("d_x", "d_y")).withColumn("speed", F.try_divide(F.col("step"), F.col("dt")))
    ok = F.col("speed") <= MAX_SPEED
    sums = d.groupBy("entity").agg(
        F.coalesce(F.sum(F.when(ok, F.col("step"))), F.lit(0.0)).alias("distance"), F.coalesce(F.max(F.when(ok, F.col("speed"))), F.lit(0.0)).alias("max_speed"), F.coalesce(F.sum("dt"), F.lit(0.0)).alias("seconds"),
    )
    runs = s.fast_runs(d, keys, ["t", "idx"], "t", ok & (F.col("speed") >= SPRINT_SPEED), SPRINT_S - 1e-9)
    return sums.join(runs.groupBy("entity").agg(F.count("*").alias("sprints")), "entity", "left").fillna(0, ["sprints"])


def heat_map(positions: DataFrame, length: float = 105.0, width: float = 68.0, nx: int = 21, ny: int = 14) -> DataFrame:
    """Seconds in each cell of the pitch; the far edges belong to the last cells. [AGG-04]"""
    inside = positions.where((F.col("x") >= 0) & (F.col("x") <= length) & (F.col("y") >= 0) & (F.col("y") <= width))
    cell = lambda c, n, size: F.least(F.floor(F.col(c) / size * n), F.lit(n - 1)).cast("int")
    return inside.groupBy("entity", cell("y", ny, width).alias("by"), cell("x", nx, length).alias("bx")).agg(F.sum(1 / F.col("fps")).alias("seconds"))


def owners(positions: DataFrame, ball: DataFrame, radius: float = RADIUS) -> DataFrame:
    """Per ball frame the nearest entity within the radius, ties to the smaller entity. [JOI-05]"""
    p = positions.select("clip_id", "idx", "entity", "team", F.col("x").alias("px"), F.col("y").alias("py"))
    both = ball.where("x is not null").join(p, ["clip_id", "idx"], "left").withColumn("d", F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")))
    near = F.min(F.when(F.col("d") <= radius, F.struct("d", "entity", "team")))
    return both.groupBy("clip_id", "idx", "t").agg(near.alias("m")).select("clip_id", "idx", "t", F.col("m.entity").alias("entity"), F.col("m.team").alias("team"))


def possessions(positions: DataFrame, ball: DataFrame, fps: float = 10.0) -> DataFrame:
    """Runs of one owner of two frames or more, joined over at most a second. [WIN-05, WIN-06]"""
    own = owners(positions, ball)
    teams = own.where("entity is not null").groupBy("clip_id", "entity").agg(F.first("team").alias("team"))
    runs = s.runs(own, ["clip_id"], "t", "idx", "entity", skip=max(1, round(0.3 * fps)), least=2, rank="idx")
    return s.merged(runs, ["clip_id"], "entity", MERGE_GAP).join(teams, ["clip_id", "entity"])


def match_passes(runs: DataFrame, ends: bool = False) -> DataFrame:
    """Passes between runs of teams 0 and 1 at most five seconds apart. [WIN-07]"""
    return s.passes(runs.where(F.col("team").isin(0, 1)), ["clip_id"], "entity", F.col("team"), PASS_GAP, ends)


def statistics(positions: DataFrame, ball: DataFrame, fps: float = 10.0) -> DataFrame:
    """A row for each entity, linked players first: minutes, movement, touches, seconds on the ball, passes. [QRY-01, AGG-02, AGG-03, AGG-06, AGG-07]"""
    seen = positions.where("x is not null").groupBy("entity", "team").agg(F.round(F.sum(1 / F.col("fps")) / 60, 1).alias("minutes"), F.round(F.avg("x"), 1).alias("avg_x"), F.round(F.avg("y"), 1).alias("avg_y"))
    runs = possessions(positions, ball, fps)
    touch = runs.groupBy("entity").agg(F.count("*").alias("touches"), F.sum(F.col("t1") - F.col("t0") + 1 / fps).alias("possession_s"))
    passed = match_passes(runs).groupBy(F.col("from_owner").alias("entity")).agg(F.sum("ok").alias("passes_ok"), F.sum(1 - F.col("ok")).alias("passes_failed"))
    out = seen.join(movement(positions), "entity", "left").join(touch, "entity", "left").join(passed, "entity", "left")
    return out.fillna(0).orderBy(~F.col("entity").startswith("p"), F.col("team"), F.desc("minutes"), "entity")


def team_totals(runs: DataFrame, passed: DataFrame, fps: float = 10.0) -> DataFrame:
    """Possession share and pass accuracy of each team. [AGG-05, AGG-07]"""
    own = runs.where(F.col("team").isin(0, 1)).groupBy("team").agg(F.sum(F.col("t1") - F.col("t0") + 1 / fps).alias("seconds"))
    acc = passed.groupBy("team").agg(F.sum("ok").alias("ok"), F.count("*").alias("n"))
    whole = F.sum("seconds").over(Window.partitionBy(F.lit(1)))  # two rows
    return own.withColumn("share", F.try_divide(100 * F.col("seconds"), whole)).join(acc, "team", "left").withColumn("accuracy", F.try_divide(100 * F.col("ok"), F.col("n"))).drop("ok", "n")


def stillness(rows: DataFrame, min_span: float = 1.5, max_speed: float = 0.15) -> DataFrame:
    """(clip_id, entity, still): the share of its time that a track stands still before the background. [AGG-10, AGG-11, AGG-32, JOI-06, SFN-02]

    rows: clip_id, entity, t, idx, fx, fy (foot in the image), height, a (array of nine: the frame's camera motion to the reference frame). A row's foot
    is moved into the image of the first row a second later; speed is in body lengths. Tracks of fewer than 8 rows, 1.5 s or 3 such
    pairs, and those with a median speed of 0.15 or more, have no share.
    """
    keys = ["clip_id", "entity"]
    at = lambda c: [c[i] for i in range(9)]
    ahead = F.expr("first(struct(t, fx, fy, a)) OVER (PARTITION BY clip_id, entity ORDER BY t RANGE BETWEEN 1.0D FOLLOWING AND UNBOUNDED FOLLOWING)")
    r = rows.withColumn("j", ahead)
    rx, ry, rw = geometry.projected(at(F.col("a")), F.col("fx"), F.col("fy"))
    px, py, _ = geometry.projected(geometry.adjugate(at(F.col("j.a"))), rx, ry)
    r = r.withColumn("moved", F.when(F.col("j").isNotNull(), F.hypot(px - F.col("j.fx"), py - F.col("j.fy")) / F.greatest(F.lit(1e-3), F.col("j.t") - F.col("t"))))
    h = r.groupBy(*keys).agg(F.greatest(F.lit(1.0), F.percentile("height", 0.5)).alias("h"), F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span"))
    v = r.where("moved is not null").join(h.where((F.col("n") >= 8) & (F.col("span") >= min_span)), keys).withColumn("v", F.col("moved") / F.col("h"))
    g = v.groupBy(*keys).agg(F.percentile("v", 0.5).alias("m"), F.avg((F.col("v") < 2 * max_speed).cast("int")).alias("still"), F.count("*").alias("pairs"))
    return g.where((F.col("pairs") >= 3) & (F.col("m") < max_speed)).select(*keys, "still")


def valid_tracks(positions: DataFrame, still: DataFrame, length: float = 105.0, width: float = 68.0, margin: float = 1.5, least: int = 10, inside_share: float = 0.6) -> DataFrame:
    """(clip_id, entity, suspect): players on the pitch, without spectators and people before the camera. [AGG-09, FLT-02, FLT-03]

    positions: clip_id, entity, x, y (null where not calibrated) and, if known, y2 and height (box bottom and image height). Out go tracks of
    fewer than `least` rows, those with most boxes at the image's bottom edge, those mostly off the pitch, and those that stand still along a
    touchline (85 % of the time). Clips without calibration have no pitch: who stands still 60 % of the time is out. So are clips whose
    calibration is suspect: fewer than 35 % of five or more moving tracks are inside.
    """
    p = positions if "y2" in positions.columns else positions.withColumn("y2", F.lit(None).cast("double")).withColumn("height", F.lit(None).cast("double"))
    inside = F.col("x").between(-margin, length + margin) & F.col("y").between(-margin, width + margin)
    a = p.groupBy("clip_id", "entity").agg(
        F.count("*").alias("n"), F.avg(F.coalesce(inside, F.lit(False)).cast("int")).alias("inside"), F.percentile("y", 0.5).alias("my"), F.count("x").alias("known"),
        F.avg(F.coalesce((F.col("height") > 0) & (F.col("y2") >= 0.99 * F.col("height")), F.lit(False)).cast("int")).alias("edge"),
    )
    j = a.join(still, ["clip_id", "entity"], "left").fillna(0.0, ["still"])
    moving = (F.col("n") >= 2 * least) & (F.col("still") < 0.5)
    whole = Window.partitionBy("clip_id")  # one row a track
    calibrated = F.sum("known").over(whole) > 0
    share = F.avg(F.when(moving, (F.col("inside") >= inside_share).cast("int"))).over(whole)
    j = j.withColumn("suspect", calibrated & (F.count_if(moving).over(whole) >= 5) & (share < 0.35)).withColumn("calibrated", calibrated & ~F.coalesce("suspect", F.lit(False)))
    my = F.coalesce("my", F.lit(0.0))
    touchline = (my < 4) | (my > width - 4)
    ok = F.when(F.col("calibrated"), (F.col("inside") >= inside_share) & ~((F.col("still") >= 0.85) & touchline)).otherwise(F.col("still") < 0.6)
    return j.where((F.col("n") >= least) & (F.col("edge") <= 0.5) & ok).select("clip_id", "entity", F.coalesce("suspect", F.lit(False)).alias("suspect"))


def cleaned_ball(ball: DataFrame, length: float = 105.0, width: float = 68.0, limit: float = 40.0) -> DataFrame:
    """The ball without positions off the pitch (margin 2 m) and without jumps, manual rows kept. [FLT-04, FLT-05, WIN-08]"""
    ok = F.col("x").between(-2, length + 2) & F.col("y").between(-2, width + 2)
    b = ball.where(ok | (F.col("kind") == "manual"))
    w = Window.partitionBy("clip_id").orderBy("t", "idx")
    dist = lambda a, c: F.hypot(F.lag("x", a).over(w) - F.lag("x", c).over(w), F.lag("y", a).over(w) - F.lag("y", c).over(w)) / (F.lag("t", c).over(w) - F.lag("t", a).over(w))
    dt = lambda a, c: F.lag("t", c).over(w) - F.lag("t", a).over(w)
    raw = (dist(1, 0) > limit) & (dist(0, -1) > limit) & (dist(1, -1) < limit) & (dt(1, 0) <= 1) & (dt(0, -1) <= 1)
    m = b.withColumn("raw", F.coalesce(raw, F.lit(False)))
    m = s.islands(m, ["clip_id"], ["t", "idx"], F.col("raw") != F.lag("raw").over(w), "i")
    place = F.row_number().over(Window.partitionBy("clip_id", "i").orderBy("t", "idx"))
    return m.withColumn("spike", F.col("raw") & (place % 2 == 1) & (F.col("kind") != "manual")).where(~F.col("spike")).drop("raw", "i", "spike")
