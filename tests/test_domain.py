"""Domain modules on the cases of FIXTURES.md and on small examples."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmill.functions import camera, geo, parsing
from trackmill.operators import grouped, timejoins
from trackmill.plans import linking, match, order, roster, sound, views
from trackmill.sources import tables
from trackmill.streaming import trackers

ONE = [float(k in (0, 4, 8)) for k in range(9)]


def test_anti_join_keeps_null_keys(spark):
    left, right = spark.createDataFrame([(1, 5), (None, 5), (2, 5)], "k int, t int"), spark.createDataFrame([(1, 5)], "k int, u int")
    span = (F.col("t") - 1, F.col("t") + 1)
    assert {r["k"] for r in timejoins.interval_semi(left, right.withColumnRenamed("u", "t2"), ["k"], span, "t2", anti=True).collect()} == {None, 2}
    assert {r["k"] for r in timejoins.interval_semi(left, right.withColumnRenamed("u", "t2"), ["k"], span, "t2").collect()} == {1}


def test_names_positions_and_thresholds(spark):
    rows = {"Jörg ten Bosch": "Jörg_ten_Bosch", "__a__": "a", "": "clip", "a/b": "a_b"}
    df = spark.createDataFrame([(k,) for k in rows], "s string")
    assert {r["s"]: r["n"] for r in df.select("s", parsing.safe_name(F.col("s")).alias("n")).collect()} == rows
    lat, lon = parsing.iso6709(F.lit("loc: +52.0907+005.1214/"))
    assert spark.range(1).select(lat, lon).first()[:] == (52.0907, 5.1214)
    p = spark.createDataFrame([(1, 1, 1, 0.2)], "f int, l int, r int, s double")
    assert grouped.greedy_pairs(p, ["f"], "l", "r", "s", 0.2).count() == 1


def test_overwrite_removes_a_clip_without_results(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10), (2, 20)], "clip_id int, v int")
    tables.overwrite(rows, f"file://{tmp_path}", "x")
    tables.overwrite(rows.where("clip_id = 1"), f"file://{tmp_path}", "x", analysed=[1, 2])
    assert [r["clip_id"] for r in spark.read.parquet(f"file://{tmp_path}/x").collect()] == [1]


def test_stations_by_the_rules(spark):
    kind = "m int, id string, e double, n double, acc double, t double"
    only = [(1, "a", 0.0, 0.0, 3.0, 0.0), (1, "b", None, None, None, None)]
    out = {r["id"]: r["station"] for r in grouped.stations(spark.createDataFrame(only, kind), ["m"], "e", "n", "acc", "t").collect()}
    assert out["a"] == out["b"]
    rows = [(1, "a", 0.0, 0.0, 3.0, 0.0), (1, "b", 9.0, 0.0, 12.0, 100.0), (1, "c", 60.0, 0.0, 4.0, 5000.0), (1, "d", None, None, None, 5100.0), (1, "e", None, None, None, None), (1, "f", None, None, None, None)]
    out = {r["id"]: r["station"] for r in grouped.stations(spark.createDataFrame(rows, kind), ["m"], "e", "n", "acc", "t").collect()}
    assert out["a"] == out["b"] and out["c"] == out["d"] and out["e"] == out["f"] and len(set(out.values())) == 3


def walkers(n, calibrated=True, y0=30.0, step=0.5):
    return [(1, f"w{k}", i, i / 10, 10.0 + i * step, (y0 + k) if calibrated else None) for k in range(n) for i in range(100)]


def valid_of(spark, rows, still=(), extra=None):
    p = spark.createDataFrame([(c, e, float(x) if y is not None else None, y, *((extra or {}).get(e, (500.0, 1080.0)))) for c, e, i, t, x, y in rows], "clip_id int, entity string, x double, y double, y2 double, height double")
    s = spark.createDataFrame(list(still) or [(9, "-", 0.0)], "clip_id int, entity string, still double")
    return {(r["entity"], r["suspect"]) for r in match.valid_tracks(p, s).collect()}


def test_valid_tracks_by_all_rules(spark):
    walker, stander = walkers(1), [(1, "s", i, i / 10, 50.0, 1.0) for i in range(100)]
    keeper = [(1, "k", i, i / 10, 0.5, 34.0) for i in range(100)]
    still = [(1, "s", 1.0), (1, "k", 1.0)]
    assert valid_of(spark, walker + stander + keeper, still) == {("w0", False), ("k", False)}
    bare = [(c, e, i, t, x, None) for c, e, i, t, x, y in walker + stander]
    assert valid_of(spark, bare, still) == {("w0", False)}
    assert valid_of(spark, walker + [(1, "n", i, i / 10, 50.0, 30.0) for i in range(100)], extra={"n": (1079.0, 1080.0)}) == {("w0", False)}
    assert valid_of(spark, walkers(6, y0=300.0)) == {(f"w{k}", True) for k in range(6)}


def test_stillness_takes_the_camera_out(spark):
    pan = lambda i: [1.0, 0.0, 5.0 * i, *ONE[3:]]  # noqa: E731  (frame to reference)
    rows = [(1, "s", i / 10, i, 500.0 - 5 * i, 300.0, 100.0, pan(i)) for i in range(30)] + [(1, "w", i / 10, i, 500.0, 300.0, 100.0, pan(i)) for i in range(30)] + [(1, "x", i / 10, i, 500.0, 300.0, 100.0, pan(i)) for i in range(5)]
    out = match.stillness(spark.createDataFrame(rows, "clip_id int, entity string, t double, idx int, fx double, fy double, height double, a array<double>")).collect()
    assert [(r["entity"], r["still"]) for r in out] == [("s", 1.0)]


CORNERS = [(52.0, 5.0), (52.0, 5.0 + 105 / (111_194.93 * math.cos(math.radians(52)))), (52.0 + 68 / 111_194.93, 5.0 + 105 / (111_194.93 * math.cos(math.radians(52)))), (52.0 + 68 / 111_194.93, 5.0)]


def test_pitch_from_corners(spark):
    df = spark.createDataFrame([([CORNERS[k] for k in (2, 0, 3, 1)], 51.9999, 5.0005)], "c array<struct<lat:double,lon:double>>, la double, lo double")
    o = df.select(geo.ordered_corners(F.col("c"), (F.col("la"), F.col("lo"))).alias("c"))
    assert [(r["lat"], r["lon"]) for r in o.first()["c"]] == CORNERS
    length, width = geo.pitch_size(F.col("c"))
    assert o.select(length, width).first()[:] == (105.0, 68.0)
    x, y = geo.on_pitch(F.lit(CORNERS[0][0]), F.lit((CORNERS[0][1] + CORNERS[1][1]) / 2), F.col("c"), 105.0, 68.0)
    assert o.select(x, y).first()[:] == pytest.approx((52.5, 68.0), abs=1e-3)
    d = geo.pitch_distance(F.lit(52.0 - 10 / 111_194.93), F.lit(5.0005), F.col("c"))
    assert o.select(d).first()[0] == pytest.approx(10, abs=0.01)
    acc = lambda la, lo, a: spark.range(1).select(geo.effective_accuracy(F.lit(la), F.lit(lo), F.lit(a))).first()[0]
    assert acc(52.09071, 5.12, 2.0) == 2.0 and acc(52.0907, 5.1214, 2.0) == pytest.approx(6.9, abs=0.2) and acc(None, 1.0, 3.0) == 3.0


def test_camera_homography_sees_what_it_looks_at(spark):
    h = camera.camera_homography(*[F.lit(x) for x in (52.5, -10.0, 5.0, math.pi / 2, 0.2, 0.0, math.log(1500), 1920.0, 1080.0)])
    m = np.array(spark.range(1).select(F.array(*h)).first()[0]).reshape(3, 3)
    p = m @ [52.5, -10 + 5 / math.tan(0.2), 1]
    assert p[2] > 0 and p[:2] / p[2] == pytest.approx((960, 540), abs=1e-6)
    right = m @ [50.0, 20.0, 1]
    assert right[0] / right[2] > 960  # looking along +y, smaller x lies to the right


def test_small_camera_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(camera.click_weight(F.lit("9"))) == 4.0 and one(camera.click_weight(F.lit(None).cast("string"))) == 1.0
    points = F.from_json(F.lit('[{"pitch":"a"},{"line":"l"},{"line":"l"},{"line":"l"},{"line":"m"}]'), "array<struct<pitch:string,line:string>>")
    assert one(camera.degrees_of_freedom(points)) == 5
    assert one(camera.confidence(F.lit(None).cast("string"), F.lit(0), F.lit(0), F.lit(True), F.lit("env"), F.lit(False), F.lit(10.0), F.lit(1.0))) == 90
    assert one(camera.confidence(F.lit("rejected"), F.lit(1), F.lit(0), F.lit(True), F.lit("env"), F.lit(False), F.lit(None).cast("double"), F.lit(1.0))) is None
    assert one(camera.better_model(F.lit(0.52), F.lit(0.5), F.lit(0.9), F.lit(0.91))) and not one(camera.better_model(F.lit(0.505), F.lit(0.5), F.lit(0.9), F.lit(0.9)))
    moved = spark.range(1).select(F.array(*camera.moved_box([F.lit(float(x)) for x in (2, 0, 5, 0, 2, 7, 0, 0, 1)], *[F.lit(float(x)) for x in (10, 20, 30, 60)]))).first()[0]
    assert moved == [25.0, 47.0, 65.0, 127.0]
    boxes = F.from_json(F.lit('[{"y1":0,"y2":100},{"y1":100,"y2":300}]'), "array<struct<y1:double,y2:double>>")
    assert one(camera.ball_diameter(boxes, F.lit(290.0))) == 25.0
    assert one(camera.continuity(F.lit(1.0), F.lit(3.0))) == pytest.approx(math.exp(-1 / 40)) and one(camera.continuity(F.lit(-0.5), F.lit(0.0))) == 0.0


CLIPS = "match_id int, id string, rec_start double, duration double, order_idx int, period int, start_minute double"


def test_order_and_timeline(spark):
    rows = [(1, "a", 0.0, 90.0, 5, 1, None), (1, "b", 300.0, 40.0, 4, 1, None), (1, "c", 1200.0, 60.0, 3, 1, None), (1, "d", 3300.0, 45.0, 2, 1, None), (1, "e", 3720.0, 30.0, 1, 1, None), (1, "x", None, 30.0, 0, 1, 0.0)]
    m = spark.createDataFrame([(1, 40)], "id int, half_length int")
    out = {r["id"]: (r["place"], r["period"], r["start_minute"]) for r in order.proposed(spark.createDataFrame(rows, CLIPS), m).collect()}
    assert out == {"a": (0, 1, 0.0), "b": (1, 1, 5.0), "c": (2, 1, 20.0), "d": (3, 2, 40.0), "e": (4, 2, 47.0), "x": (5, 1, 0.0)}
    rows = [(1, i, t, 30.0, k, 1, None) for k, (i, t) in enumerate({"b": 300.0, "a": 60.0, "d": 3000.0, "c": 1500.0, "e": 3600.0}.items())]
    s = spark.createDataFrame([(1, 0.0, 2880.0, "d", 40)], "match_id int, kickoff double, kickoff2 double, second_clip string, half_length int")
    out = {r["id"]: r["start_minute"] for r in order.timed(spark.createDataFrame(rows, CLIPS), s).collect()}
    assert out == {"a": 1.0, "b": 5.0, "c": 25.0, "d": 42.0, "e": 52.0}


def test_sound_events(spark):
    rows = []
    for k in range(900):
        cheer, whistle = 400 <= k < 440 or 460 <= k < 475, 200 <= k < 208
        rows.append((1, k, -30.0 + (15.0 if cheer else 0.0), 0.3, 0.1, 0.9 if whistle else 0.1, 40.0 if whistle else 2.0))
    out = sound.sound_events(spark.createDataFrame(rows, "clip_id long, k long, level double, bright double, low double, w_frac double, w_peak double")).orderBy("t").collect()
    assert [(r["kind"], r["t"], r["t_end"]) for r in out] == [("whistle", 20.0, 20.8), ("cheer", 40.0, 44.0)]
    tone = np.sin(2 * np.pi * 3100 * np.arange(1600) / 16_000)
    f = sound.features(spark.createDataFrame([(1, 0, tone.tolist()), (1, 1, (np.sin(2 * np.pi * 200 * np.arange(1600) / 16_000)).tolist())], "clip_id long, k long, samples array<double>")).orderBy("k").collect()
    assert f[0]["w_frac"] > 0.95 and f[0]["w_peak"] > 25 and f[1]["low"] > 0.9


def test_ball_path_gaps_and_hand(spark):
    frames = spark.createDataFrame([(1, i, i / 5) for i in range(13)], "clip_id int, idx int, t double")
    ball = spark.createDataFrame([(1, i, 100.0 + i, 50.0, 0.9) for i in (0, 2, 4, 9, 10, 11, 12)], "clip_id int, idx int, x double, y double, conf double")
    manual = spark.createDataFrame([(1, 2.0, 7.0, 7.0), (1, 0.2, None, None)], "clip_id int, t double, x double, y double")
    out = {r["idx"]: (r["x"], r["kind"]) for r in views.ball_path(frames, ball, manual).collect()}
    assert out[0] == (100.0, "found") and out[3] == (pytest.approx(103.0), "filled") and out[10] == (7.0, "hand") and 1 not in out and out[6][1] == "filled"


def test_projection_between_keyframes_and_minimap(spark):
    pan = [1.0, 0.0, 10.0, *ONE[3:]]
    frames = spark.createDataFrame([(1, 0, 0.0, ONE), (1, 1, 1.0, pan), (1, 2, 2.0, ONE)], "clip_id int, idx int, t double, a array<double>")
    scale = lambda k: [k, 0.0, 0.0, 0.0, k, 0.0, 0.0, 0.0, 1.0]
    keys = spark.createDataFrame([(1, 0.0, scale(0.1), ONE), (1, 2.0, scale(0.2), ONE)], "clip_id int, t double, h array<double>, a array<double>")
    det = spark.createDataFrame([(1, i, 7, 90.0, 0.0, 110.0, 200.0) for i in range(3)], "clip_id int, idx int, track_id int, x1 double, y1 double, x2 double, y2 double")
    pos = views.on_pitch(det, views.bracketed(frames, keys))
    got = {r["idx"]: (r["x"], r["y"]) for r in pos.collect()}
    assert got[0] == pytest.approx((10, 20)) and got[2] == pytest.approx((20, 40)) and got[1] == pytest.approx((16.5, 30))  # (100 + 10) by the mean scale
    p = pos.select("clip_id", "idx", F.lit("p1").alias("entity"), F.lit(0).alias("team"), "x", "y")
    b = spark.createDataFrame([(1, 1, 5.0, 6.0)], "clip_id int, idx int, x double, y double")
    m = views.minimap(frames, p, b, p.select("clip_id", "entity"), 1.0, 2.0).orderBy("idx").collect()
    assert [len(r["players"]) for r in m] == [1, 1] and m[0]["ball"]["x"] == 5.0 and m[1]["ball"] is None


def test_boxes_at_times(spark):
    d = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 10.0, 10.0), (1, 0.5, 10.0, 0.0, 20.0, 10.0), (1, 5.0, 0.0, 0.0, 1.0, 1.0)], "clip_id int, t double, x1 double, y1 double, x2 double, y2 double")
    at = spark.createDataFrame([(1, 0.25), (1, 0.6), (1, 2.0), (1, 4.9), (1, 0.0)], "clip_id int, asked double")
    out = {r["asked"]: r["x1"] for r in views.box_at(d, at).collect()}
    assert out == {0.25: pytest.approx(5.0), 0.6: 10.0, 4.9: 0.0, 0.0: 0.0}
    assert {r["asked"] for r in views.shown_boxes(d, at).collect()} == {0.25, 0.6, 0.0}


def summary_rows(spark, tracks):
    rows = [(1, k, i, t0 + i / 10, x + i * 0.1, 50.0, x + 20 + i * 0.1, 150.0, x + i * 0.1, 20.0) for k, (t0, n, x) in tracks.items() for i in range(n)]
    return linking.summaries(spark.createDataFrame(rows, "clip_id int, track_id int, idx int, t double, x1 double, y1 double, x2 double, y2 double, x double, y double"))


def test_link_suggestions(spark):
    s = summary_rows(spark, {1: (0.0, 30, 10.0), 2: (3.5, 55, 13.0), 3: (3.5, 55, 90.0), 4: (1.0, 30, 12.0)})
    t = spark.createDataFrame([(1, 1, 7, 0, [50.0, 0.0, 0.0]), (1, 2, None, 0, [50.0, 1.0, 0.0]), (1, 3, None, -1, None), (1, 4, None, 0, None)], "clip_id int, track_id int, player_id int, team int, lab array<double>")
    out = linking.suggestions(s, t, 7, 0).collect()
    assert [r["track_id"] for r in out] == [2, 3] and out[0]["score"] > 0.9 > out[1]["score"] and "same shirt" in out[0]["reason"]


def test_recognition_and_numbers(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    p = spark.createDataFrame([(10, 0, a), (11, 0, b)], "player_id int, team int, emb array<double>")
    t = spark.createDataFrame([(1, 2, 0, [0.9, 0.1, 0.1], 0.0, 5.0), (1, 3, 0, [0.5, 0.5, 0.7], 0.0, 5.0)], "clip_id int, track_id int, team int, emb array<double>, t0 double, t1 double")
    none = spark.createDataFrame([(9, 1, 0.0, 1.0)], "clip_id int, player_id int, t0 double, t1 double")
    assert [(r["track_id"], r["player_id"]) for r in linking.recognised(t, p, none).collect()] == [(2, 10)]
    seen = spark.createDataFrame([(1, 10, 4.0, 8.0)], "clip_id int, player_id int, t0 double, t1 double")
    assert linking.recognised(t.where("track_id = 2"), p.where("player_id = 10"), seen).count() == 0
    players = spark.createDataFrame([(1, " 9", 0), (2, "9", 0), (3, "9", 1)], "id int, number string, team int")
    tr = spark.createDataFrame([(1, 5, None, "9", 0.8, 0), (1, 6, None, "9", 0.3, 0), (1, 7, 4, "9", 0.9, 1)], "clip_id int, track_id int, player_id int, jersey_guess string, jersey_conf double, team int")
    assert [(r["track_id"], r["player_id"]) for r in linking.auto_assigned(tr, players).collect()] == [(5, 2)]


def test_stitching_candidates(spark):
    lab = [50.0, 0.0, 0.0]
    rows = [(1, 1, 0, 19, (100.0, 50.0), (195.0, 50.0), (5.0, 0.0), 100.0, 100.0, lab), (1, 2, 24, 43, (215.0, 50.0), (215.0, 50.0), (0.0, 0.0), 100.0, 100.0, lab), (1, 3, 24, 43, (220.0, 50.0), (220.0, 50.0), (0.0, 0.0), 100.0, 100.0, [50.0, 60.0, 0.0])]
    s = spark.createDataFrame(rows, "clip_id int, track_id int, s int, e int, p0 struct<x:double,y:double>, p1 struct<x:double,y:double>, v struct<x:double,y:double>, h0 double, h1 double, lab array<double>")
    assert [(r["a"], r["b"]) for r in linking.stitch_candidates(s, 10.0).collect()] == [(1, 2)]


def test_teams_by_colour(spark):
    rng = np.random.default_rng(0)
    rows = [(1, k, [50 + rng.normal(), 60 + rng.normal(), 40 + rng.normal()], 50, 0) for k in range(11)] + [(1, 20 + k, [40 + rng.normal(), 10 + rng.normal(), -50 + rng.normal()], 50, 0) for k in range(11)] + [(1, 40, [90.0, -10.0, 80.0], 50, 0)]
    out = {r["track_id"]: r["team_auto"] for r in linking.teams_by_colour(spark.createDataFrame(rows, "clip_id int, track_id int, lab array<double>, n_frames int, team int")).collect()}
    red, blue = {out[k] for k in range(11)}, {out[20 + k] for k in range(11)}
    assert len(red) == len(blue) == 1 and red | blue == {0, 1} and out[40] == 2
    c = spark.createDataFrame([(1, 0, [50.0, 60.0, 0.0]), (1, 1, [50.0, 0.0, 60.0])], "clip_id int, team int, lab array<double>")
    assert not linking.aligned_teams(c, c).first()["swapped"] and linking.aligned_teams(c, c.withColumn("team", 1 - F.col("team"))).first()["swapped"]
    t = spark.createDataFrame([(1, 0, "#ff0000", 1), (1, 0, "#000000", 3), (1, 1, "#0000ff", None)], "clip_id int, team int, color string, n_frames int")
    assert {r["team"]: r["color"] for r in linking.team_centres(t).collect()} == {0: "#400000", 1: "#0000ff"}


def test_roster(spark):
    have = spark.createDataFrame([(1, "Ann", "7", 0), (1, "Bo", None, 0)], "match_id long, name string, number string, team int")
    new = spark.createDataFrame([(0, " ann ", "9"), (1, "Cy", "7"), (2, "Di", "8"), (3, "Ed", "8"), (4, "", "5"), (5, "di", None), (6, "Fay", "")], "place int, name string, number string")
    assert [(r["name"], r["number"]) for r in roster.merged_roster(have, new, 1, 0).collect()] == [("Di", "8"), ("Fay", None)]
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, name string, secret int")
    out = roster.changed(base, spark.createDataFrame([(1, "c", 9)], "id int, name string, secret int"), "id", ["name"])
    assert sorted(map(tuple, out.collect())) == [(1, "c", 5), (2, "b", 6)]
    jobs = spark.createDataFrame([(1, "x", 5, 1), (2, "x", 5, 2), (3, "y", 5, 3), (4, "y", 6, 4)], "job_id int, kind string, target int, created int")
    ups = spark.createDataFrame([(1, "running", 0.5, 1), (3, "running", 0.1, 1), (3, "done", 1.0, 2)], "job_id int, state string, progress double, at int")
    assert [r["job_id"] for r in roster.queue(jobs, ups).collect()] == [1, 4]
    o = roster.overview(jobs, ups).first()
    assert (o["jobs"], o["waiting"], o["running"], o["done"], o["progress"]) == (4, 2, 1, 1, pytest.approx(0.375))
    v = [(1, 52.0, 5.0, 10.0, -5.0, 3.0), (2, 52.0001, 5.0, None, None, None), (3, 53.0, 5.0, None, None, None)]
    got = roster.venue_memory(spark.createDataFrame(v, "id int, gps_lat double, gps_lon double, cam_x double, cam_y double, cam_h double")).collect()
    assert [(r["id"], r["from_id"], r["cam_x"]) for r in got] == [(2, 1, 10.0)]


def test_ball_tracker_and_static_balls(spark, tmp_path):
    rows = [(1, i, 100.0 + 10 * i, 200.0, 0.5, 12.0) for i in range(20)] + [(1, i, 900.0, 700.0, 0.4, 12.0) for i in range(3, 20, 3)]
    kind = "clip_id long, idx int, x double, y double, conf double, size double"
    c = spark.createDataFrame(rows, kind)
    out = trackers.ball_tracks(c, 1920, 1080).collect()
    assert len(out) == 20 and all(r["y"] == 200.0 for r in out)
    for k in (0, 10):
        c.where(f"idx >= {k} and idx < {k + 10}").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = trackers.ball_stream(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in"), 1920, 1080)
    q = stream.writeStream.format("memory").queryName("balls").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["idx"], r["x"]) for r in spark.table("balls").collect()} == {(r["idx"], r["x"]) for r in out}
    pan = lambda i: [1.0, 0.0, 4.0 * i, *ONE[3:]]
    logo = [(1, i, 800.0 - 4 * i, 300.0, 0.08, pan(i)) for i in range(0, 60, 2)]
    move = [(2, i, 100.0 + 9 * i, 300.0, 0.08, pan(i)) for i in range(0, 60, 2)]
    sure = [(3, i, 800.0 - 4 * i, 300.0, 0.6, pan(i)) for i in range(0, 60, 2)]
    left = trackers.without_static(spark.createDataFrame(logo + move + sure, "clip_id int, idx int, x double, y double, conf double, a array<double>")).groupBy("clip_id").count().collect()
    assert {r["clip_id"]: r["count"] for r in left} == {2: 30, 3: 30}
