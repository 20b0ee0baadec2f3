"""Shots at goal from the ball's path, their outcome and shooter, goal chances, and the score.

`ball`: clip_id, idx, t, x, y (metres, nulls dropped). Every lookup has an equality on the clip; shots are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmill.operators.sequences import islands

#: Thresholds of the domain (fixed values): m/s, m, m, m, s, s, s.
MIN_SPEED, MAX_DISTANCE, WIDE, GOAL_HALF, AHEAD_S, WITHIN_S, MERGE_S = 40 / 3.6, 30.0, 6.0, 3.66, 0.15, 0.6, 1.5


def candidates(ball: DataFrame, length: float = 105.0, width: float = 68.0) -> DataFrame:
    """Ball samples that fly at a goal. [JOI-07, FLT-10, SFN-30]

    Speed is measured to the first sample 0.15 s later or else to the last, within 0.6 s.
    """
    at = "struct(t, x, y)"
    later = F.expr(f"first({at}) OVER (PARTITION BY clip_id ORDER BY t RANGE BETWEEN {AHEAD_S}D FOLLOWING AND UNBOUNDED FOLLOWING)")
    last = F.expr(f"last({at}) OVER (PARTITION BY clip_id ORDER BY t, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
    b = ball.where("x is not null and y is not null").select("clip_id", "idx", "t", "x", "y").withColumn("j", F.coalesce(later, last))
    b = b.withColumn("dt", F.col("j.t") - F.col("t")).where((F.col("dt") > 0) & (F.col("dt") <= WITHIN_S))
    b = b.withColumn("vx", (F.col("j.x") - F.col("x")) / F.col("dt")).withColumn("vy", (F.col("j.y") - F.col("y")) / F.col("dt")).withColumn("speed", F.hypot("vx", "vy"))
    b = b.where((F.col("speed") >= MIN_SPEED) & (F.abs("vx") >= 1e-6)).withColumn("goal_x", F.when(F.col("vx") < 0, 0.0).otherwise(length))
    s = F.try_divide(F.col("goal_x") - F.col("x"), F.col("vx"))
    b = b.where((F.hypot(F.col("goal_x") - F.col("x"), width / 2 - F.col("y")) <= MAX_DISTANCE) & (s > 0)).withColumn("y_cross", F.col("y") + s * F.col("vy"))
    off = F.abs(F.col("y_cross") - width / 2) - GOAL_HALF
    return b.where(off <= WIDE).select("clip_id", "idx", "t", F.col("j.t").alias("t_end"), "x", "y", "speed", "goal_x", "y_cross", (off <= 0.5).alias("on_target"))


def detected(ball: DataFrame, possessions: DataFrame, length: float = 105.0, width: float = 68.0) -> DataFrame:
    """Shots: candidates merged while they follow within 1.5 s at one goal, with outcome and last owner. [WIN-10, WIN-11, JOI-14]"""
    w = Window.partitionBy("clip_id").orderBy("t", "idx")
    c = candidates(ball, length, width)
    apart = (F.col("t") - F.lag("t_end").over(w) >= MERGE_S) | (F.col("goal_x") != F.lag("goal_x").over(w))
    first = lambda name: F.min_by(name, F.struct("t", "idx")).alias(name)
    shots = islands(c, ["clip_id"], ["t", "idx"], apart, "shot").groupBy("clip_id", "shot").agg(
        F.min("t").alias("t"), F.max("t_end").alias("t_end"), first("x"), first("y"), first("goal_x"), first("y_cross"), first("on_target"), F.round(F.max("speed") * 3.6).alias("speed_kmh"),
    )
    b = ball.where("x is not null and y is not null").select("clip_id", F.col("t").alias("bt"), F.col("x").alias("bx"), F.col("y").alias("by"))
    b = b.withColumn("next_t", F.lead("bt").over(Window.partitionBy("clip_id").orderBy("bt")))
    j = shots.select("clip_id", "shot", "t", "t_end", "goal_x").join(b, "clip_id").where((F.col("bt") >= F.col("t")) & (F.col("bt") <= F.col("t_end") + 2))
    line = (F.col("bt") > F.col("t")) & (F.abs(F.col("bx") - F.col("goal_x")) < 2) & (F.abs(F.col("by") - width / 2) < GOAL_HALF + 0.5)
    ends = j.groupBy("clip_id", "shot").agg(F.max(line.cast("int")).alias("line"), F.max_by(F.struct("bt", "bx", "by", "next_t", "goal_x"), "bt").alias("z"))
    gap = F.coalesce(F.col("z.next_t") - F.col("z.bt"), F.lit(99.0))
    ends = ends.select("clip_id", "shot", (F.col("line") == 1).alias("ball_at_line"), ((gap > 0.7) & (F.hypot(F.col("z.bx") - F.col("z.goal_x"), F.col("z.by") - width / 2) < 12)).alias("lost_near_goal"))
    p = possessions.select("clip_id", "entity", "team", "t0", "t1")
    own = shots.select("clip_id", "shot", "t").join(p, "clip_id").where((F.col("t0") <= F.col("t") + 0.3) & (F.col("t1") >= F.col("t") - 1.5))
    own = own.groupBy("clip_id", "shot").agg(F.max_by(F.struct("entity", "team"), F.struct("t1", -F.col("t0"))).alias("o"))
    out = shots.join(ends, ["clip_id", "shot"], "left").join(own, ["clip_id", "shot"], "left")
    return out.withColumn("entity", F.col("o.entity")).withColumn("team", F.coalesce("o.team", F.lit(-1))).drop("o")


def with_chance(shots: DataFrame, sounds: DataFrame) -> DataFrame:
    """How likely a goal is, from cheering, a whistle and the ball. [JOI-11, SFN-19]"""
    s = sounds.select("clip_id", "kind", F.col("t").alias("st"))
    j = shots.select("clip_id", "shot", "t", "t_end").join(s, "clip_id")
    cheer = (F.col("kind") == "cheer") & F.col("st").between(F.col("t") - 1, F.col("t_end") + 15)
    whistle = (F.col("kind") == "whistle") & F.col("st").between(F.col("t_end"), F.col("t_end") + 60)
    heard = j.groupBy("clip_id", "shot").agg(F.max(cheer.cast("int")).alias("cheer"), F.max(whistle.cast("int")).alias("whistle"))
    out = shots.join(heard, ["clip_id", "shot"], "left").fillna(0, ["cheer", "whistle"])
    points = F.col("cheer") + F.col("whistle") + (F.col("ball_at_line") | F.col("lost_near_goal")).cast("int")
    chance = F.when(~F.col("on_target"), None).when((points >= 2) & ((F.col("cheer") == 1) | F.col("ball_at_line")), "likely").when(points >= 1, "possible")
    return out.withColumn("chance", chance)


def suggestions(shots: DataFrame, stored: DataFrame) -> DataFrame:
    """Detected shots that no stored one lies within 1.5 s of, likely goals first. [JOI-12, TOP-08]"""
    known = stored.select("clip_id", F.col("t").alias("kt"))
    near = (F.abs(shots["t"] - known["kt"]) < MERGE_S) & (shots["clip_id"] == known["clip_id"])
    rank = F.when(F.col("chance") == "likely", 0).when(F.col("chance") == "possible", 1).otherwise(2)
    return shots.join(known, near, "left_anti").orderBy(rank, "clip_id", "t")


def totals(stored: DataFrame, players: DataFrame) -> DataFrame:
    """Shots, shots on target and goals of each team; a shot without a team takes its player's. [AGG-17, AGG-18, JOI-22]"""
    p = players.select(F.col("id").alias("player_id"), F.col("team").alias("player_team"))
    s = stored.where("status = 'confirmed'").join(p, "player_id", "left").withColumn("side", F.coalesce("team", "player_team"))
    return s.groupBy("side").agg(F.count("*").alias("shots"), F.count_if("on_target").alias("on_target"), F.count_if("goal").alias("goals"))


def timeline(stored: DataFrame) -> DataFrame:
    """Goals in order with the running score. [AGG-19, PRJ-03]"""
    w = Window.partitionBy("match_id").orderBy("period", "minute", "id").rowsBetween(Window.unboundedPreceding, 0)
    goals = stored.where("status = 'confirmed' and goal")
    return goals.select("match_id", "id", "period", "minute", "team", *[F.sum((F.col("team") == k).cast("int")).over(w).alias(f"score{k}") for k in (0, 1)])
