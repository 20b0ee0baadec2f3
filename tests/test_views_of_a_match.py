"""The match report, venues, the link assistant's other half, spectators in other clips, timeline guesses, pitch tables and warps."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmill.functions import camera, pitch
from trackmill.plans import linking, order, report, venues, views
from trackmill.sources import tables


def one(c):
    from pyspark.sql import SparkSession

    return SparkSession.active().range(1).select(c.alias("c")).first()["c"]


def test_report_of_a_match(spark):
    """Clip 1: player 10 runs with the ball and passes to 11, who loses it to track 3; clip 2 (second half) is turned; a referee and an invalid track don't count."""
    pos, ball = [], []
    for i in range(200):
        t = i / 10
        pos += [(1, i, t, 1, 10.0 + 0.8 * i, 20.0), (1, i, t, 2, 60.0, 30.0), (1, i, t, 3, 80.0, 40.0), (1, i, t, 4, 10.0, 10.0), (1, i, t, 5, 50.0, 60.0)]
        ball.append((1, i, t, *((10.0 + 0.8 * i, 20.5) if i < 50 else (60.0, 30.5) if i < 100 else (80.0, 40.2))))
        pos.append((2, i, t, 7, 5.0, 8.0))
    tracks = [(1, 1, 10, 1), (1, 2, 11, 0), (1, 3, None, 1), (1, 4, None, 2), (1, 5, None, 0), (2, 7, 10, 0)]
    df = lambda rows, kind: spark.createDataFrame(rows, kind)
    out = report.report(
        df(pos, "clip_id int, idx int, t double, track_id int, x double, y double"), df(ball, "clip_id int, idx int, t double, x double, y double"),
        df(tracks, "clip_id int, track_id int, player_id int, team int"), df([(10, "Ann", "9", 0), (11, "Bo", "4", 0), (12, "Cy", None, 1)], "id int, name string, number string, team int"),
        df([(1, 5, "a.mp4", "done", 10.0, None, 1), (2, 5, "b.mp4", "done", 10.0, None, 2), (3, 5, "c.mp4", "new", 10.0, None, 2)], "id int, match_id int, filename string, status string, fps double, flip boolean, period int"),
        df([(5, "Reds", "Blues"), (6, "X", "Y")], "id int, team0_name string, team1_name string"), df([(1, 1), (1, 2), (1, 3), (1, 4), (2, 7)], "clip_id int, track_id int"),
    )
    got = {r["match_id"]: r.asDict(True) for r in out.collect()}
    assert got[6]["players"] == got[6]["events"] == got[6]["pass_network"] == got[6]["clips"] == [] and [t["possession_pct"] for t in got[6]["teams"]] == [None, None]
    m = got[5]
    assert [(p["entity"], p["name"], p["number"], p["team"]) for p in m["players"]] == [("p10", "Ann", "9", 0), ("p11", "Bo", "4", 0), ("c1t3", "Track 3 (a.mp4)", None, 1)]
    ann = m["players"][0]
    assert (ann["minutes"], ann["passes"], ann["passes_failed"], ann["possessions"], ann["sprints"]) == (0.7, 1, 0, 1, 1)
    assert ann["distance_m"] == pytest.approx(0.8 * 199, abs=2) and ann["max_speed_kmh"] == pytest.approx(28.8, abs=0.1)
    turned = [10.0 + 0.8 * i for i in range(200)] + [100.0] * 200
    assert ann["avg_x"] == pytest.approx(sum(turned) / 400, abs=0.06) and ann["avg_y"] == 40.0
    assert sum(c["seconds"] for c in ann["heat_map"]) == pytest.approx(sum(0 <= x <= 105 for x in turned) / 10)
    assert [(e["kind"], e["entity"], e["to"]) for e in m["events"]] == [("sprint", "p10", None), ("pass", "p10", "p11"), ("lost ball", "p11", "c1t3")]
    assert m["pass_network"] == [{"from": "p10", "to": "p11", "n": 1}]
    assert [(t["name"], t["possession_pct"], t["passes"], t["pass_accuracy_pct"]) for t in m["teams"]] == [("Reds", 50.0, 1, 50.0), ("Blues", 50.0, 0, None)]
    assert [(c["clip_id"], c["calibrated"]) for c in m["clips"]] == [(1, True), (2, True), (3, False)]


def rectangle(rng, turn, length, width, lat, lon, away):
    """Corners of a pitch whose lower touchline's middle is `away` metres before the camera at (lat, lon), and where the camera is."""
    u, v = np.array([math.cos(turn), math.sin(turn)]), np.array([-math.sin(turn), math.cos(turn)])
    middle = v * (away + width / 2) + u * rng.uniform(-20, 20)
    ring = [middle + u * a * length / 2 + v * b * width / 2 for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    r = 6_371_000.0
    return [{"lat": lat + math.degrees(q[1] / r), "lon": lon + math.degrees(q[0] / (r * math.cos(math.radians(lat))))} for q in ring], length / 2 - middle @ u, width / 2 + away + width / 2


def test_camera_on_the_nearest_pitch(spark):
    rng = random.Random(3)
    rows, want = [], []
    for k in range(40):
        lat, lon = rng.uniform(-60, 60), rng.uniform(-179.999, 179.999)
        near, x, y = rectangle(rng, rng.uniform(0, 7), 100, 64, lat, lon, 6.0)
        far = rectangle(rng, rng.uniform(0, 7), 105, 68, lat, lon, 150.0)[0]
        small = rectangle(rng, rng.uniform(0, 7), 30, 20, lat, lon, 1.0)[0]
        rows.append((k, lat, lon, [far, near, None, small, near[:2]], 100.0, 64.0))
        want.append((x, y))
    rows += [(90, 1.0, 1.0, [], 105.0, 68.0), (91, None, 1.0, [rows[0][3][0]], 105.0, 68.0), (92, 1.0, 1.0, None, 105.0, 68.0)]
    got = {r["id"]: r["place"] for r in venues.camera_on_pitch(spark.createDataFrame(rows, "id int, lat double, lon double, polygons array<array<struct<lat: double, lon: double>>>, length double, width double")).collect()}
    for k, (x, y) in enumerate(want):
        assert got[k]["x"] == pytest.approx(x, abs=0.2) and got[k]["y"] == pytest.approx(y, abs=0.2)
        assert (got[k]["pitch_length"], got[k]["pitch_width"], got[k]["distance_to_pitch"]) == (pytest.approx(100, abs=0.3), pytest.approx(64, abs=0.3), pytest.approx(6, abs=0.2))
    assert got[90] is None and got[91] is None and got[92] is None


def test_least_rectangles():
    rng = np.random.default_rng(4)
    for _ in range(60):
        p = rng.normal(0, [9, 4], (rng.integers(3, 20), 2))
        middle, along, length, width = venues.least_rectangle(p)
        best = min(np.ptp(p @ [math.cos(a), math.sin(a)]) * np.ptp(p @ [-math.sin(a), math.cos(a)]) for a in np.linspace(0, math.pi / 2, 4001))
        assert length * width <= best + 1e-9 and length * width == pytest.approx(best, rel=1e-2) and length >= width
        q = (p - middle) @ np.stack([along, [-along[1], along[0]]]).T
        assert np.abs(q).max(0) == pytest.approx([length / 2, width / 2])


def test_venues_are_remembered(spark):
    step = 1 / 111_194.93  # a metre of latitude
    v = spark.createDataFrame([(1, 50.0, 5.0, 100.0, 60.0, True), (2, 50.0 + 60 * step, 5.0, 90.0, 55.0, False), (3, 51.0, 5.0, None, None, False)], "id int, lat double, lon double, pitch_length double, pitch_width double, corners boolean")
    m = spark.createDataFrame([(10, 50.0 + 20 * step, 5.0, True), (11, 50.0 + 40 * step, 5.0, True), (12, 50.0, 5.0, False), (13, 50.0 + 500 * step, 5.0, True), (14, None, None, True)], "id int, lat double, lon double, corners boolean")
    assert {r["id"]: r["venue_id"] for r in venues.remembered(v, m).collect()} == {10: 1, 11: 2, 12: 2, 13: None, 14: None}
    assert {r["id"]: (r["venue_id"], r["pitch_length"]) for r in venues.known_size(m, v).collect()} == {10: (1, 100.0), 11: (2, 90.0), 12: (1, 100.0)}
    clips = [(1, 7, 50.0, 5.0, 9.0, 9.0, 2.0, "hand"), (2, 7, 50.0 + 5 * step, 5.0, None, None, None, None), (3, 7, 50.0 + 9 * step, 5.0, None, None, None, None), (4, 8, 50.0, 5.0, None, None, None, None), (5, 7, 50.0 + 4 * step, 5.0, 1.0, 1.0, 1.0, "gps")]
    out = venues.shared_cameras(spark.createDataFrame(clips, "id int, match_id int, gps_lat double, gps_lon double, cam_x double, cam_y double, cam_h double, cam_source string")).collect()
    assert [(r["id"], r["from_id"], r["cam_x"]) for r in out] == [(2, 1, 9.0)]


def test_continuity_in_the_image(spark):
    c = lambda gap, moved, ratio: one(camera.continuity_seen(F.lit(gap), F.lit(moved), F.lit(ratio)))
    assert c(-0.4, 0.0, 1.0) == 0 and c(0.0, 0.4, 1.0) == 1
    assert c(2.0, 4.0, 1.0) == pytest.approx(math.exp(-0.05)) and c(2.0, 4.0, 1.7) == pytest.approx(0.3 * math.exp(-0.05)) and c(4.0, 4.0, 1.7) == pytest.approx(math.exp(-0.1))
    assert c(2.0, 12.0, 1.0) == pytest.approx(math.exp(-2 - 0.05))


def summary_row(track, t0, t1, foot, h=100.0, place=None):
    end = lambda t: (t, int(t * 10), *foot)
    return (1, track, 50, end(t0), end(t1), place, place, h, h)


SUMMARY = "clip_id int, track_id int, n int, first struct<t: double, idx: int, fx: double, fy: double>, last struct<t: double, idx: int, fx: double, fy: double>, p0 struct<x: double, y: double>, p1 struct<x: double, y: double>, h0 double, h1 double"


def test_suggestions_without_calibration_with_numbers_and_likeness(spark):
    s = spark.createDataFrame([summary_row(1, 0.0, 10.0, (100.0, 500.0)), summary_row(2, 11.0, 15.0, (150.0, 500.0)), summary_row(3, 11.0, 15.0, (900.0, 500.0)), summary_row(4, 5.0, 15.0, (100.0, 500.0)), summary_row(5, 12.0, 14.0, (300.0, 500.0))], SUMMARY)
    t = spark.createDataFrame([(1, 1, 9, 0, None, None, None), (1, 2, None, 0, "7", 0.9, 0.5), (1, 3, None, -1, "8", 0.9, None), (1, 4, None, 0, None, None, None), (1, 5, None, 0, "8", 0.3, 0.0)], "clip_id int, track_id int, player_id int, team int, jersey_guess string, jersey_conf double, look double")
    t = t.withColumn("lab", F.lit(None).cast("array<double>"))
    out = {r["track_id"]: r for r in linking.suggestions(s, t, 9, 0, number=" 7 ").collect()}
    assert set(out) == {2, 3, 5}  # 4 is seen together with 1
    fit = math.exp(-1 / 40)
    assert out[2]["score"] == pytest.approx(min(1, (0.3 + 0.7 * fit) * 1.5 * 1.4), abs=1e-3) and out[2]["reason"] == "follows after 1.0 s, looks like the profile"
    moved, half = 8.0, 0.5 * 4.5
    far = math.exp(-0.5 * ((moved - half) / half) ** 2) * fit
    assert out[3]["score"] == pytest.approx((0.3 + 0.7 * far) * 0.3, abs=1e-3)
    assert out[5]["reason"].endswith("does not look like the profile")
    # The camera turned by 800 pixels between the two: track 3 is where track 1 was.
    a = lambda dx: [1.0, 0.0, dx, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    motion = spark.createDataFrame([(1, i, a(0.0 if i <= 105 else -800.0)) for i in range(0, 160)], "clip_id int, idx int, a array<double>")
    out = {r["track_id"]: r["score"] for r in linking.suggestions(s, t, 9, 0, motion=motion).collect()}
    assert out[3] == pytest.approx(0.3 + 0.7 * fit, abs=1e-3)


def test_spectators_in_all_clips(spark):
    rng = random.Random(9)
    rows = []
    for clip, track in itertools.product((1, 2, 3), range(40)):
        lab = None if rng.random() < 0.1 else [50 + rng.gauss(0, 8), rng.gauss(0, 5), rng.gauss(0, 5)]
        seen, placed = rng.random() < 0.8, clip < 3 and rng.random() < 0.8
        rows.append((clip, track, lab, *((rng.uniform(0, 600), rng.uniform(0, 300)) if seen else (None, None)), *((rng.uniform(0, 12), rng.uniform(-4, 4)) if placed else (None, None)), rng.uniform(40, 120), rng.choice([0.2, 0.5, 0.9]), rng.random() < 0.9, rng.random() < 0.1))
    marked = [r for r in rows if r[0] == 1 and r[2] is not None][:3]
    keep = "clip_id int, track_id int, lab array<double>, ax double, ay double, x double, y double, h double, still double, valid boolean, linked boolean"
    df = spark.createDataFrame(rows, keep)
    got = {(r["clip_id"], r["track_id"]): r["score"] for r in linking.like_spectators(df, spark.createDataFrame(marked, keep).select("clip_id", "track_id", "lab", "ax", "ay", "x", "y", "h"), most=1000).collect()}
    want = {}
    for r in rows:
        if any(r[:2] == c[:2] for c in marked) or r[2] is None or r[8] < 0.4 or not r[9] or r[10]:
            continue
        for c in marked:
            if math.sqrt(0.25 * (r[2][0] - c[2][0]) ** 2 + (r[2][1] - c[2][1]) ** 2 + (r[2][2] - c[2][2]) ** 2) > 14:
                continue
            if r[0] == c[0] and r[3] is not None and c[3] is not None:
                d = math.hypot(r[3] - c[3], r[4] - c[4]) / c[7]
                near = d <= 1.5
            elif r[5] is not None and c[5] is not None:
                d = math.hypot(r[5] - c[5], r[6] - c[6]) / 4
                near = d <= 1
            else:
                continue
            if near:
                want[r[:2]] = max(want.get(r[:2], 0), r[8] * math.exp(-d))
    assert got.keys() == want.keys() and len(want) > 5
    assert all(got[k] == pytest.approx(v, abs=1e-3) for k, v in want.items())


def test_guessed_timelines(spark):
    clips = [(1, 5, 1000.0, 600.0, 0), (2, 5, 1700.0, 600.0, 1), (3, 5, 3200.0, 600.0, 2), (4, 5, 4160.0, None, 3), (5, 5, None, 10.0, 4), (6, 6, 10.0, 100.0, 0), (7, 6, 409.0, 100.0, 1), (8, 7, None, 1.0, 0)]
    out = order.guessed(spark.createDataFrame(clips, "id int, match_id int, rec_start double, duration double, order_idx int"), spark.createDataFrame([(5, None, None, 40), (6, 3.0, None, None), (7, None, None, None)], "id int, kickoff double, kickoff2 double, half_length int"))
    got = {r["match_id"]: tuple(r)[1:] for r in out.collect()}
    assert got == {5: (3, 15, 1000.0, 3200.0, 40, 1), 6: (None, None, 3.0, None, 45, 0), 7: (None, None, None, None, 45, 1)}


def test_pitch_tables(spark):
    at = {r["name"]: (r["x"], r["y"]) for r in pitch.landmarks(spark, 100.0, 60.0).collect()}
    assert len(at) == 11 + 2 * 13
    assert at["corner right bottom"] == (100, 60) and at["penalty spot right"] == (89, 30) and at["goal post left top"] == (0, 26.34) and at["penalty area right corner top"] == (83.5, 9.84)
    assert math.hypot(at["penalty arc left top"][0] - 11, at["penalty arc left top"][1] - 30) == pytest.approx(9.15, abs=1e-3)
    assert pitch.segments(spark).count() == 5 + 2 * 6
    frames = {r["name"]: r for r in pitch.goal_frames(spark).collect()}
    assert len(frames) == 6 and frames["crossbar right"]["by"] - frames["crossbar right"]["ay"] == pytest.approx(7.32) and all(r["up"] == 2.44 for r in frames.values())
    s = pitch.line_samples(spark).toPandas()
    assert ((s.dx**2 + s.dy**2 - 1).abs() < 1e-9).all()
    circle = s[s.line == "centre circle"]
    assert np.hypot(circle.x - 52.5, circle.y - 34).to_numpy() == pytest.approx(np.full(len(circle), 9.15))
    for _, g in s.sort_values("i").groupby("line"):
        assert np.hypot(np.diff(g.x), np.diff(g.y)).max() < 0.6
    arc = s[s.line == "penalty arc left"]
    assert arc.x.min() == pytest.approx(16.5) and arc.x.max() == pytest.approx(20.15, abs=0.01)


def test_grids_stand_for_a_view(spark):
    h = [F.lit(float(v)) for v in (18, 0, 10, 0, 15, 20, 0, 0, 1)]
    g = one(pitch.keyframe_grid(h, F.lit(1920), F.lit(1080)))
    assert len(g) == 12 and all(p["x"] == pytest.approx(18 * p["px"] + 10, abs=0.02) and p["y"] == pytest.approx(15 * p["py"] + 20, abs=0.02) for p in g)
    assert one(pitch.keyframe_grid(h, F.lit(30), F.lit(30))) == []


def test_points_move_with_the_camera(spark):
    a = lambda dx: [1.0, 0.0, dx, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    motion = spark.createDataFrame([(1, 0, a(0.0)), (1, 5, a(-30.0))], "clip_id int, idx int, a array<double>")
    p = spark.createDataFrame([(1, 0, 5, 10.0, 20.0), (1, 5, 0, 10.0, 20.0), (1, 0, 9, 1.0, 1.0)], "clip_id int, idx_from int, idx_to int, x double, y double")
    got = {(r["idx_from"], r["idx_to"]): (r["wx"], r["wy"]) for r in views.warped(p, motion).collect()}
    assert got == {(0, 5): (40.0, 20.0), (5, 0): (-20.0, 20.0), (0, 9): (None, None)}
    rows = spark.createDataFrame([(1, 5, 0.0, 0.0, 10.0, 50.0), (1, 7, 0.0, 0.0, 1.0, 1.0)], "clip_id int, idx int, x1 double, y1 double, x2 double, y2 double")
    assert [(r["ax"], r["ay"]) for r in linking.anchored_feet(rows, motion).orderBy("idx").collect()] == [(-25.0, 50.0), (None, None)]


def test_a_failing_overwrite_keeps_clips_without_new_rows(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    tables.overwrite(spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "clip_id int, v int"), root, "x")
    bad = spark.createDataFrame([(1, 5)], "clip_id int, v int").withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        tables.overwrite(bad, root, "x", analysed=[1, 2])
    read = lambda: sorted((r["clip_id"], r["v"]) for r in spark.read.parquet(f"{root}/x").collect())
    assert read() == [(1, 1), (2, 2), (3, 3)]
    tables.overwrite(spark.createDataFrame([(1, 5)], "clip_id int, v int"), root, "x", analysed=[1, 2])
    assert read() == [(1, 5), (3, 3)]
