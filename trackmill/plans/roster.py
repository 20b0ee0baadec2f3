"""Matches, clips, players, profiles, training material and jobs as queries over their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions import parsing
from trackmill.operators import choose, spatial, timejoins
from trackmill.plans import shots
from trackmill.sources import tables


def match_list(matches: DataFrame, clips: DataFrame, stored_shots: DataFrame, players: DataFrame) -> DataFrame:
    """Matches, latest first, with their clips and the score (null without goals). [QRY-11, AGG-18, AGG-20, TOP-12]"""
    n = clips.groupBy(F.col("match_id").alias("id")).agg(F.count("*").alias("n_clips"))
    p = players.select(F.col("id").alias("player_id"), F.col("team").alias("__pt"))
    goals = stored_shots.where("status = 'confirmed' and goal").join(p, "player_id", "left").withColumn("side", F.coalesce("team", "__pt"))
    score = goals.groupBy(F.col("match_id").alias("id")).agg(F.array(F.count_if(F.col("side") == 0), F.count_if(F.col("side") == 1)).alias("score"))
    return matches.join(n, "id", "left").fillna(0, ["n_clips"]).join(score, "id", "left").orderBy(F.coalesce("date", "created_at").desc(), F.desc("id"))


def track_list(tracks: DataFrame, valid: DataFrame, open_only: bool = False, hide_spectators: bool = False) -> DataFrame:
    """Tracks with whether they are valid; only unlinked ones, or without spectators, if asked. [QRY-12, FLT-17, FLT-03]"""
    v = valid.select("clip_id", "track_id", F.lit(True).alias("valid"))
    t = tracks.join(v, ["clip_id", "track_id"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    t = t.where("player_id is null") if open_only else t
    return t.where("valid or player_id is not null") if hide_spectators else t


def squad(players: DataFrame) -> DataFrame:
    """Players in order of team, shirt number and name. [TOP-11, TOP-14]"""
    return players.orderBy("team", parsing.leading_number(F.col("number")), "name", "id")


def merged_roster(have: DataFrame, new: DataFrame, match_id: int, team: int) -> DataFrame:
    """The rows of `new` (place, name, number) to add to a team: named, their name and number both new, among themselves the earlier counts. [JOI-23, JOI-21]

    Whether a row is taken depends on the rows taken before it, so one fold goes over the list, which is a form's worth of players.
    """
    h = have.where((F.col("match_id") == match_id) & (F.col("team") == team)).agg(
        F.array_distinct(F.collect_list(F.lower(F.trim("name")))).alias("names"), F.array_distinct(F.collect_list(F.trim("number"))).alias("numbers")
    )
    rows = new.agg(F.array_sort(F.collect_list(F.struct("place", F.trim(F.coalesce("name", F.lit(""))).alias("name"), F.nullif(F.trim("number"), F.lit("")).alias("number")))).alias("rows"))
    zero = F.struct(F.col("names"), F.col("numbers"), F.array().cast("array<struct<place:int,name:string,number:string>>").alias("taken"))

    def step(acc, r):
        r = F.struct(r["place"].cast("int").alias("place"), r["name"].alias("name"), r["number"].alias("number"))
        known = F.array_contains(acc["names"], F.lower(r["name"])) | F.coalesce(F.array_contains(acc["numbers"], r["number"]), F.lit(False))
        more = F.struct(
            F.array_append(acc["names"], F.lower(r["name"])).alias("names"), F.when(r["number"].isNull(), acc["numbers"]).otherwise(F.array_append(acc["numbers"], r["number"])).alias("numbers"),
            F.array_append(acc["taken"], r).alias("taken"),
        )
        return F.when((r["name"] == "") | known, acc).otherwise(more)

    taken = h.join(F.broadcast(rows)).select(F.aggregate("rows", zero, step, lambda acc: acc["taken"]).alias("t"))  # one row each
    return taken.select(F.explode("t").alias("r")).select(F.lit(match_id).cast("long").alias("match_id"), "r.name", "r.number", F.lit(team).alias("team"))


def profiles_of(players: DataFrame, profiles: DataFrame, squads: DataFrame) -> DataFrame:
    """Players with their profile's vector: by squad and name in any case, else the profile of the match's player. [JOI-27, JOI-21]"""
    by_name = profiles.where("squad_id is not null").select("squad_id", F.lower(F.trim("name")).alias("__n"), F.col("emb").alias("e1"))
    by_player = profiles.where("match_player_id is not null").select(F.col("match_player_id").alias("id"), F.col("emb").alias("e2"))
    p = players.join(squads, ["match_id", "team"], "left").withColumn("__n", F.lower(F.trim("name")))
    return p.join(by_name, ["squad_id", "__n"], "left").join(by_player, "id", "left").withColumn("emb", F.coalesce("e1", "e2")).drop("e1", "e2", "__n")


def changed(base: DataFrame, changes: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Base with the allowed columns of `changes` in place of its own (a null is no change); other columns are ignored. [SNK-03]"""
    names = [c for c in changes.columns if c in allowed and c in base.columns]
    c = changes.select(key, *[F.col(n).alias(f"__{n}") for n in names])
    return base.join(c, key, "left").select(*[F.coalesce(f"__{n}", n).alias(n) if n in names else F.col(n) for n in base.columns])


def training_examples(frames: DataFrame, most_hard: int, most_easy: int) -> DataFrame:
    """Frames for the detector's training: those with corrections first, then evenly spread others, with their hold-out mark. [QRY-14, TOP-10, FLT-13, SET-03]

    frames: clip_id, t, hard. One in seven stretches of ten seconds is held out.
    """
    # A limit that is a number cuts each task's rows before they meet.
    some = lambda of, most: choose.top_k(frames.where(of), ["hard"], [F.xxhash64("clip_id", "t"), "clip_id", "t"], most).drop("rank")
    both = some(F.col("hard"), most_hard).union(some(~F.col("hard"), most_easy))
    return both.withColumn("held_out", F.pmod(F.floor(F.col("t") / 10) + F.col("clip_id"), F.lit(7)) == 3)


def field_examples(frames: DataFrame, keyframes: DataFrame, most: int = 600) -> DataFrame:
    """Frames (clip_id, idx, t) with a calibration to trust, for the field's training: those nearest to every half second within two seconds of a keyframe set by hand,
    accepted, or found with a precision of 0.9 or more; over `most`, every n-th. [QRY-14]"""
    good = F.col("accepted") | ~F.col("auto") | (F.coalesce("precision", F.lit(0.0)) >= 0.9)
    wanted = keyframes.where(F.coalesce(good, F.lit(False))).select("clip_id", F.explode(F.transform(F.sequence(F.lit(-4), F.lit(4)), lambda k: F.round((F.col("t") + k / 2) * 1_000_000).cast("long"))).alias("us")).distinct()
    at = frames.select("clip_id", F.round(F.col("t") * 1_000_000).cast("long").alias("us"), (-F.col("idx")).alias("i"))
    near = timejoins.as_of(wanted, at, ["clip_id"], "us", "i", "nearest", name="frame").where("frame is not null")
    rows = near.select("clip_id", (-F.col("frame.v")).alias("idx")).distinct().join(frames, ["clip_id", "idx"])
    per_clip = rows.groupBy("clip_id").agg(F.count("*").alias("n"))
    first = per_clip.select("clip_id", (F.sum("n").over(Window.orderBy("clip_id")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("all"))  # a row a clip
    place = F.row_number().over(Window.partitionBy("clip_id").orderBy("idx")) - 1 + F.col("before")
    step = F.greatest(F.lit(1), F.ceil(F.col("all") / most))
    return rows.join(first, "clip_id").withColumn("k", place).where(F.col("k") % step == 0).drop("k", "before", "all")


def filmed_at(clips: DataFrame) -> DataFrame:
    """(match_id, lat, lon): the median position of a match's clips; none where no clip has one. [AGG-22]"""
    return clips.where("gps_lat is not null and gps_lon is not null").groupBy("match_id").agg(F.percentile("gps_lat", 0.5).alias("lat"), F.percentile("gps_lon", 0.5).alias("lon"))


def saved_profiles(base: DataFrame, new: DataFrame) -> DataFrame:
    """Profiles (squad_id, name, match_player_id, emb, n) with `new` ones in place of those of the same squad and name in any case, or, without a squad, of the same match player. [JOI-27, SNK-04]"""
    key = F.when(F.col("squad_id").isNotNull(), F.concat_ws("/", F.lit("s"), "squad_id", F.lower(F.trim("name")))).otherwise(F.concat_ws("/", F.lit("p"), "match_player_id"))
    return tables.upserted(base.withColumn("__key", key), new.withColumn("__key", key), ["__key"]).drop("__key")


def split_counts(examples: DataFrame) -> DataFrame:
    """How many examples train and how many are held out. [AGG-29]"""
    return examples.agg(F.count_if(~F.col("held_out")).alias("train"), F.count_if("held_out").alias("held_out"))


def model_versions(registry: DataFrame, kind: str) -> DataFrame:
    """The active version of a kind of model: the latest activated one. [SNK-14]"""
    return choose.latest(registry.where((F.col("kind") == kind) & F.col("activated").isNotNull()), ["kind"], ["activated", "id"])


def latest_status(updates: DataFrame) -> DataFrame:
    """Each job's last reported state: kind, state, progress. [SNK-13, STR-06]"""
    return choose.latest(updates, ["job_id"], ["at"])


def queue(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Jobs that wait, oldest first, one of each kind and target; jobs that ran when the process ended wait again. [STR-09, STR-07]"""
    s = latest_status(updates).select("job_id", "state")
    open_ = jobs.join(s, "job_id", "left").where(F.coalesce("state", F.lit("waiting")).isin("waiting", "running"))
    first = Window.partitionBy("kind", "target").orderBy("created", "job_id")
    return open_.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k").orderBy("created", "job_id")


def overview(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Jobs per state, with their mean progress: done counts 1, running its share, others 0. [QRY-17, AGG-23, AGG-33, AGG-34]"""
    j = jobs.join(latest_status(updates).select("job_id", "state", "progress"), "job_id", "left").withColumn("state", F.coalesce("state", F.lit("waiting")))
    done = F.when(F.col("state") == "done", 1.0).when(F.col("state") == "running", F.coalesce("progress", F.lit(0.0))).otherwise(0.0)
    return j.groupBy().agg(F.count("*").alias("jobs"), *[F.count_if(F.col("state") == s).alias(s) for s in ("waiting", "running", "done", "failed")], F.avg(done).alias("progress"))


def durations(clips: DataFrame) -> DataFrame:
    """Seconds of video of each match, 0 where unknown. [AGG-21]"""
    return clips.groupBy("match_id").agg(F.coalesce(F.sum("duration"), F.lit(0.0)).alias("seconds"))


def keyframe_counts(clips: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Clips with their keyframes, and those set by hand. [AGG-28]"""
    k = keyframes.groupBy(F.col("clip_id").alias("id")).agg(F.count("*").alias("keyframes"), F.count_if(~F.col("auto")).alias("by_hand"))
    return clips.select("id", "match_id").join(k, "id", "left").fillna(0, ["keyframes", "by_hand"])


def anchors(clips: DataFrame, dof: DataFrame) -> DataFrame:
    """Per station the clip whose keyframe tells most (dof: clip_id, dof); of equal ones the first. [STA-19]"""
    j = clips.select("match_id", "station", F.col("id").alias("clip_id")).join(dof, "clip_id")
    return j.groupBy("match_id", "station").agg(F.max_by("clip_id", F.struct("dof", (-F.col("clip_id")).alias("c"))).alias("clip_id"), F.max("dof").alias("dof"))


def venue_memory(clips: DataFrame, reach: float = 30.0) -> DataFrame:
    """Clips without a camera place take that of the nearest clip with one, filmed within 30 m (clips: id, gps_lat, gps_lon, cam_x, cam_y, cam_h). [STA-14, JOI-17]"""
    known = clips.where("cam_x is not null").select(F.col("id").alias("from_id"), "gps_lat", "gps_lon", *[F.col(c) for c in ("cam_x", "cam_y", "cam_h")])
    near = spatial.nearest_within(clips.where("cam_x is null"), known, reach, "id", "from_id", ("gps_lat", "gps_lon"))
    return near.join(known, "from_id").select("id", "from_id", "cam_x", "cam_y", "cam_h", F.round("metres", 1).alias("metres"))


def shots_overview(ball: DataFrame, possessions: DataFrame, sounds: DataFrame, stored: DataFrame, players: DataFrame, clips: DataFrame) -> dict[str, DataFrame]:
    """All that a match's page of shots shows: suggestions not yet stored, team and player totals, the running score. [QRY-04, PRJ-03, TOP-08]"""
    found = shots.with_chance(shots.detected(ball, possessions), sounds)
    c = clips.select(F.col("id").alias("clip_id"), "period", "start_minute")
    timed = stored.join(c, "clip_id").withColumn("minute", F.round(F.coalesce("start_minute", F.lit(0.0)) + F.col("t") / 60, 2))
    per_player = stored.where("status = 'confirmed' and player_id is not null").groupBy("player_id").agg(F.count("*").alias("shots"), F.count_if("on_target").alias("on_target"), F.count_if("goal").alias("goals"))
    return {"suggestions": shots.suggestions(found, stored), "teams": shots.totals(stored, players), "players": per_player, "timeline": shots.timeline(timed)}
