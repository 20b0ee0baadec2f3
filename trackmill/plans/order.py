"""Order, half and start minute of clips from their recording times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BREAK_S, GUESS_S = 480.0, 300.0


def recorded(clips: DataFrame, probes: DataFrame) -> DataFrame:
    """Clips with the probed recording start where theirs is missing. [SRC-16]"""
    p = probes.select(F.col("clip_id").alias("id"), F.col("rec_start").alias("__probed"))
    return clips.join(p, "id", "left").withColumn("rec_start", F.coalesce("rec_start", "__probed")).drop("__probed")


def proposed(clips: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Per clip place, period and start_minute: in order of recording, the second half after the first largest pause of eight minutes or more; clips
    without a time come last and keep theirs. [QRY-09, WIN-14, WIN-15]"""
    w = Window.partitionBy("match_id").orderBy("rec_start", "order_idx", "id")
    whole = Window.partitionBy("match_id")
    half = matches.select(F.col("id").alias("match_id"), F.coalesce("half_length", F.lit(45)).alias("half")) if matches is not None else None
    c = clips.join(half, "match_id", "left") if half is not None else clips.withColumn("half", F.lit(45))
    known = c.where("rec_start is not null")
    gap = F.col("rec_start") - (F.lag("rec_start").over(w) + F.coalesce(F.lag("duration").over(w), F.lit(0.0)))
    k = known.withColumn("k", F.row_number().over(w) - 1).withColumn("gap", gap)
    cut = F.min(F.when(F.col("gap") >= BREAK_S, F.struct((-F.col("gap")).alias("g"), F.col("k").alias("k"), F.col("rec_start").alias("t")))).over(whole)
    k = k.withColumn("cut", cut).withColumn("first", F.min("rec_start").over(whole))
    second = F.coalesce(F.col("k") >= F.col("cut.k"), F.lit(False))
    minute = F.when(second, (F.col("rec_start") - F.col("cut.t")) / 60 + F.coalesce("half", F.lit(45))).otherwise((F.col("rec_start") - F.col("first")) / 60)
    done = k.select("match_id", "id", F.col("k").alias("place"), F.when(second, 2).otherwise(1).alias("period"), F.round(minute, 1).alias("start_minute"), F.rint(-F.col("cut.g") / 60).cast("int").alias("break_minutes"))
    n = known.groupBy("match_id").agg(F.count("*").alias("n"))
    rest = c.where("rec_start is null").withColumn("j", F.row_number().over(Window.partitionBy("match_id").orderBy("order_idx", "id")) - 1).join(n, "match_id", "left")
    rest = rest.select("match_id", "id", (F.coalesce("n", F.lit(0)) + F.col("j")).alias("place"), "period", "start_minute", F.lit(None).cast("int").alias("break_minutes"))
    return done.unionByName(rest)


def guessed(clips: DataFrame, matches: DataFrame) -> DataFrame:
    """Per match what its timeline likely is: the clip after its longest pause of five minutes or more (the first of equal ones), the pause in minutes, kick-off times, clips without a
    time. Times that the match (id, kickoff, kickoff2, half_length, any null) has already stay. [WIN-16, QRY-09]"""
    w = Window.partitionBy("match_id").orderBy("rec_start", "order_idx", "id")
    pause = F.col("rec_start") - (F.lag("rec_start").over(w) + F.coalesce(F.lag("duration").over(w), F.lit(0.0)))
    c = clips.where("rec_start is not null").withColumn("pause", pause)
    cut = F.when(F.col("pause") >= GUESS_S, F.struct("pause", (-F.col("rec_start")).alias("t"), (-F.col("order_idx")).alias("o"), (-F.col("id")).alias("id")))
    g = c.groupBy("match_id").agg(F.min("rec_start").alias("first"), F.max(cut).alias("cut"))
    none = clips.groupBy("match_id").agg(F.count_if(F.col("rec_start").isNull()).alias("without_time"))
    m = matches.select(F.col("id").alias("match_id"), *[F.col(x).alias(f"m_{x}") for x in ("kickoff", "kickoff2", "half_length")])
    out = none.join(g, "match_id", "left").join(m, "match_id", "left")
    return out.select(
        "match_id", (-F.col("cut.id")).alias("second_clip"), F.rint(F.col("cut.pause") / 60).cast("int").alias("gap_minutes"), F.coalesce("m_kickoff", "first").alias("kickoff"),
        F.coalesce("m_kickoff2", -F.col("cut.t")).alias("kickoff2"), F.coalesce("m_half_length", F.lit(45)).alias("half_length"), "without_time",
    )


def timed(clips: DataFrame, settings: DataFrame) -> DataFrame:
    """Per clip place, period and start_minute from kick-off times and the clip that begins the second half (settings: match_id, kickoff, kickoff2,
    second_clip, half_length); clips without a time come last and keep theirs. [WIN-16]"""
    whole = Window.partitionBy("match_id")
    c = clips.join(settings, "match_id")
    t = c.where("rec_start is not null").withColumn("t2", F.max(F.when(F.col("id") == F.col("second_clip"), F.col("rec_start"))).over(whole)).withColumn("t1", F.min("rec_start").over(whole))
    second = F.coalesce(F.col("rec_start") >= F.col("t2"), F.lit(False))
    since = F.col("rec_start") - F.when(second, F.coalesce("kickoff2", "t2")).otherwise(F.coalesce("kickoff", "t1"))
    minute = F.when(second, F.col("half_length")).otherwise(0) + F.greatest(F.lit(0.0), since / 60)
    order = Window.partitionBy("match_id").orderBy(F.col("rec_start").asc_nulls_last(), "order_idx", "id")
    done = t.select("id", F.when(second, 2).otherwise(1).alias("p"), F.round(minute, 1).alias("m"))
    return clips.withColumn("place", F.row_number().over(order) - 1).join(done, "id", "left").select("match_id", "id", "place", F.coalesce("p", "period").alias("period"), F.coalesce("m", "start_minute").alias("start_minute"))
