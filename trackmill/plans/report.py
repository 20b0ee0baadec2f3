"""A match's statistics as one result: players, teams, events and the pass network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackmill.operators import sequences as s
from trackmill.plans import match, views


def counted_positions(positions: DataFrame, tracks: DataFrame, players: DataFrame, clips: DataFrame, valid: DataFrame, length: float = 105.0, width: float = 68.0) -> DataFrame:
    """Positions (clip_id, idx, t, track_id, x, y) of tracks that count, with match_id, entity, team, player_id, fps and px, py: the place with the first half's direction of play.

    A linked player's team overrides the track's; referees don't count unless linked; valid: clip_id, track_id. A clip is turned if its `flip` says so, or, unknown, in the second half.
    """
    t = views.counted(views.teams(tracks, players)).select("clip_id", "track_id", "entity", F.coalesce("team", F.lit(-1)).alias("team"), "player_id")
    t = t.join(valid.select("clip_id", "track_id").distinct(), ["clip_id", "track_id"], "left_semi")
    c = clips.select(F.col("id").alias("clip_id"), "match_id", "fps", F.coalesce("flip", F.col("period") == 2, F.lit(False)).alias("__flip"))
    p = positions.join(t, ["clip_id", "track_id"]).join(c, "clip_id")
    turn = lambda v, size: F.when(F.col("__flip"), size - F.col(v)).otherwise(F.col(v))
    return p.withColumn("px", turn("x", length)).withColumn("py", turn("y", width)).drop("__flip")


def players_of(p: DataFrame, runs: DataFrame, passed: DataFrame, players: DataFrame, clips: DataFrame, length: float, width: float) -> DataFrame:
    """A row for each entity of a match: who, minutes, movement, mean place, heat map, passes, possessions."""
    names = players.select(F.col("id").alias("player_id"), "name", "number", F.col("team").alias("own_team"))
    files = clips.select(F.col("id").alias("clip_id"), "filename")
    # An unlinked entity is one track; a player may have several, in several clips.
    first = F.min(F.struct("clip_id", "track_id", "team"))
    seen = F.col("x").isNotNull()
    rows = p.groupBy("match_id", "entity").agg(
        F.max("player_id").alias("player_id"), first.alias("first"), F.sum(F.when(seen, 1 / F.col("fps"))).alias("seconds"),
        F.round(F.avg(F.when(seen, F.col("px"))), 1).alias("avg_x"), F.round(F.avg(F.when(seen, F.col("py"))), 1).alias("avg_y"),
    )
    heat = match.heat_map(p.select("entity", "fps", F.col("px").alias("x"), F.col("py").alias("y")), length, width)
    heat = heat.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("by", "bx", "seconds"))).alias("heat_map"))  # cells of a grid
    done = passed.groupBy(F.col("from_owner").alias("entity")).agg(F.sum("ok").alias("passes"), F.sum(1 - F.col("ok")).alias("passes_failed"))
    held = runs.groupBy("entity").agg(F.count("*").alias("possessions"))
    out = rows.join(match.movement(p).drop("seconds"), "entity", "left").join(heat, "entity", "left").join(done, "entity", "left").join(held, "entity", "left").join(names, "player_id", "left")
    out = out.withColumn("clip_id", F.col("first.clip_id")).join(files, "clip_id", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "match_id", "entity", "player_id", F.coalesce("name", F.concat(F.lit("Track "), F.col("first.track_id"), F.lit(" ("), F.coalesce("filename", F.lit("?")), F.lit(")"))).alias("name"), "number",
        F.coalesce("own_team", "first.team").alias("team"), F.round(F.coalesce("seconds", F.lit(0.0)) / 60, 1).alias("minutes"), F.round(F.coalesce("distance", F.lit(0.0))).cast("long").alias("distance_m"),
        F.round(F.coalesce("max_speed", F.lit(0.0)) * 3.6, 1).alias("max_speed_kmh"), count("sprints"), "avg_x", "avg_y", "heat_map", count("passes"), count("passes_failed"), count("possessions"),
    )


def teams_of(runs: DataFrame, passed: DataFrame, matches: DataFrame, fps: DataFrame) -> DataFrame:
    """Two rows a match: possession share, passes and their accuracy; null where there was none."""
    both = matches.select(F.col("id").alias("match_id"), F.explode(F.array(*[F.struct(F.lit(k).alias("team"), F.col(f"team{k}_name").alias("name")) for k in (0, 1)])).alias("x")).select("match_id", "x.*")
    own = runs.join(fps, "clip_id").where(F.col("team").isin(0, 1)).groupBy("match_id", "team").agg(F.sum(F.col("t1") - F.col("t0") + 1 / F.col("fps")).alias("seconds"))
    done = passed.join(fps, "clip_id").groupBy("match_id", "team").agg(F.sum("ok").alias("passes"), F.count("*").alias("tried"))
    j = both.join(own, ["match_id", "team"], "left").join(done, ["match_id", "team"], "left")
    whole = F.sum("seconds").over(Window.partitionBy("match_id"))  # two rows
    return j.select(
        "match_id", "team", "name", F.round(F.try_divide(100 * F.coalesce("seconds", F.lit(0.0)), whole), 1).alias("possession_pct"), F.coalesce("passes", F.lit(0)).cast("long").alias("passes"),
        F.round(F.try_divide(100 * F.col("passes"), F.col("tried")), 1).alias("pass_accuracy_pct"),
    )


def sprints_of(p: DataFrame) -> DataFrame:
    """(match_id, clip_id, t, t_end, entity, value): sprints with their top speed in km/h."""
    keys = ["clip_id", "entity", "segment"]
    d = s.steps(match.smoothed_positions(p), keys, ["t", "idx"], "t", ["x", "y"])
    d = d.withColumn("step", F.hypot("d_x", "d_y")).withColumn("speed", F.try_divide(F.col("step"), F.col("dt")))
    fast = (F.col("speed") <= match.MAX_SPEED) & (F.col("speed") >= match.SPRINT_SPEED)
    runs = s.fast_runs(d, keys, ["t", "idx"], "t", fast, match.SPRINT_S - 1e-9, value="speed")
    return runs.select("clip_id", F.col("t0").alias("t"), F.col("t1").alias("t_end"), "entity", F.round(F.col("top") * 3.6, 1).alias("value"))


def report(positions: DataFrame, ball: DataFrame, tracks: DataFrame, players: DataFrame, clips: DataFrame, matches: DataFrame, valid: DataFrame, length: float = 105.0, width: float = 68.0, fps: float = 10.0) -> DataFrame:
    """One row a match with all that its page of statistics shows. [QRY-01]

    players: linked ones first, then by team and minutes; teams; events: sprints, passes and lost balls in order of clip and time; pass_network: successful passes from one to another;
    clips: which are calibrated. clips: id, match_id, filename, status, fps, flip, period; matches: id, team0_name, team1_name; ball: cleaned, clip_id, idx, t, x, y.
    Matches without any position have empty lists. Each list is as long as a match has players, passes, clips: it is sorted within its row.
    """
    p = counted_positions(positions, tracks, players, clips, valid, length, width)
    runs = match.possessions(p, ball, fps)
    passed = match.match_passes(runs, ends=True)
    of_clip = clips.select(F.col("id").alias("clip_id"), "match_id", "fps")
    listed = lambda df, order, name: df.groupBy("match_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*[c for c in df.columns if c != "match_id"]).alias("v")))), lambda x: x["v"]).alias(name))
    who = players_of(p, runs, passed, players, clips, length, width)
    who = listed(who, [F.col("player_id").isNull().alias("u"), F.col("team").alias("g"), (-F.col("minutes")).alias("m"), F.col("entity").alias("e")], "players")
    teams = listed(teams_of(runs, passed, matches, of_clip), [F.col("team").alias("g")], "teams")
    none = F.lit(None)
    sprint = sprints_of(p).select("clip_id", "t", "t_end", F.lit("sprint").alias("kind"), "entity", none.cast("string").alias("to"), "value")
    ball_events = passed.select("clip_id", "t", "t_end", F.when(F.col("ok") == 1, "pass").otherwise("lost ball").alias("kind"), F.col("from_owner").alias("entity"), F.col("to_owner").alias("to"), none.cast("double").alias("value"))
    events = sprint.union(ball_events).join(of_clip.select("clip_id", "match_id"), "clip_id")
    events = listed(events, ["clip_id", "t", "kind", "entity"], "events")
    network = passed.where("ok = 1").join(of_clip, "clip_id").groupBy("match_id", F.col("from_owner").alias("from"), F.col("to_owner").alias("to")).agg(F.count("*").alias("n"))
    network = listed(network, ["from", "to"], "pass_network")
    state = clips.join(positions.where("x is not null").select(F.col("clip_id").alias("id"), F.lit(True).alias("calibrated")).distinct(), "id", "left")
    state = listed(state.select("match_id", F.col("id").alias("clip_id"), "filename", "status", F.coalesce("calibrated", F.lit(False)).alias("calibrated")), ["clip_id"], "clips")
    out = matches.select(F.col("id").alias("match_id"))
    for part in (state, who, teams, events, network):
        name = part.columns[1]
        out = out.join(part, "match_id", "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(part.schema[name].dataType)))
    return out
