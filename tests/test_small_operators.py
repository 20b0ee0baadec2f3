"""Operators that no query reaches: stored keyframes, priors, texts, lists, examples, profiles, teams with corrections, overlays."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmill.functions import camera, geometry, parsing
from trackmill.operators import grouped
from trackmill.plans import linking, roster, sound, views
from trackmill.sources import keyframes, tables


def one(*cs):
    from pyspark.sql import SparkSession

    r = SparkSession.active().range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cs)]).first()
    return r[0] if len(cs) == 1 else tuple(r)


def test_clicks_from_json(spark):
    text = json.dumps([
        {"name": "corner", "img": [1, 2.5], "pitch": [0, 68], "z": "2"}, {"img": [3, 4], "line": [[0, 0], [105, 0]], "z": "far"},
        {"img": [5, 6], "pitch3": [0, 30.3, 2.44]}, {"img": [7, 8], "line3": [[0, 30, 2.44], [0, 37, 2.44]]}, {"other": 1},
    ])
    got = [tuple(c) for c in one(keyframes.clicks(F.lit(text)))]
    n = None
    assert got == [(1, 2.5, 0, 68, n, n, n, n, n, 2), (3, 4, n, n, 0, 0, 105, 0, n, n), (5, 6, 0, 30.3, n, n, n, n, 2.44, n), (7, 8, n, n, 0, 30, 0, 37, 2.44, n), (n,) * 10]
    assert one(keyframes.clicks(F.lit("["))) is None and one(keyframes.clicks(F.lit(None).cast("string"))) is None and one(keyframes.clicks(F.lit("[]"))) == []
    s = one(keyframes.score(F.lit('{"turn": 3.5, "lines": true}')))
    assert (s["turn"], s["lines"], s["precision"]) == (3.5, True, None)


def test_camera_priors(spark):
    n = lambda k: F.lit(None).cast(k)
    p = one(camera.camera_prior(F.lit("hand"), F.lit(1.0), F.lit(2.0), n("double"), n("double"), F.lit(50.0), F.lit(1920), F.lit(180.0)))
    assert p["uncertain"] == 3 and p["height"] == 1.6 and p["yaw"] == pytest.approx(math.pi) and p["focal"] == pytest.approx(960 / math.tan(math.radians(28.5)))
    p = one(camera.camera_prior(F.lit("gps"), F.lit(1.0), F.lit(2.0), F.lit(2.0), F.lit(900.0), n("double"), F.lit(1920), n("double")))
    assert (p["uncertain"], p["height"], p["focal"], p["yaw"]) == (11, 2, 900, None)
    assert one(camera.camera_prior(F.lit("gps"), F.lit(1.0), F.lit(2.0), F.lit(2.0), F.lit(900.0), F.lit(0.5), F.lit(1920), n("double")))["uncertain"] == 4
    assert one(camera.camera_prior(F.lit("gps"), n("double"), F.lit(2.0), F.lit(2.0), F.lit(900.0), F.lit(0.5), F.lit(1920), n("double"))) is None


def test_texts_and_small_rules(spark):
    t = lambda s: one(parsing.time_left(F.lit(s)))
    assert (t(89.0), t(90.0), t(3599.0), t(5400.0)) == ("less than 2 min left", "about 2 min left", "about 60 min left", "about 1.5 h left")
    assert one(parsing.match_minute(F.lit(45.0), F.lit(130.0))) == "47'" and one(parsing.match_minute(F.lit(None).cast("double"), F.lit(59.0))) == "0'"
    box = lambda *v: [F.lit(float(x)) for x in v]
    assert one(geometry.overlap_ratio(box(0, 0, 2, 2), box(1, 1, 3, 3))) == pytest.approx(1 / 7) and one(geometry.overlap_ratio(box(0, 0, 1, 1), box(5, 5, 6, 6))) == 0
    h = [F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, -1)]
    points = F.array(*[F.struct(F.lit(float(k)).alias("x"), F.lit(1.0).alias("y")) for k in range(3)])
    assert one(*camera.oriented(h, points)) == (-1, 0, 0, 0, -1, 0, 0, 0, 1)
    assert one(*camera.rescaled_camera(F.lit(50.0), F.lit(70.0), (100.0, 60.0), (110.0, 66.0))) == (55.0, 76.0) and one(*camera.rescaled_camera(F.lit(50.0), F.lit(-4.0), (100.0, 60.0), (110.0, 66.0))) == (55.0, -4.0)
    at = F.create_map(F.lit("spot"), F.struct(F.lit(9.0).alias("x"), F.lit(8.0).alias("y")))
    clicks = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y")) for n in ("spot", "other")])
    assert [tuple(r) for r in one(camera.remapped(clicks, at))] == [("spot", 9.0, 8.0), ("other", 1.0, 2.0)]
    mirror = [F.lit(float(x)) for x in (-1, 0, 10, 0, 1, 0, 0, 0, 1)]
    upright, level = camera.unmirrored(mirror, F.lit(5.0), F.lit(3.0))
    assert one(camera.mirrored_view(mirror)) and one(*upright) == (1, 0, 0, 0, 1, 0, 0, 0, 1) and not one(camera.mirrored_view(level))
    assert one(camera.residual([F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)], F.lit(1.0), F.lit(1.0), F.lit(4.0), F.lit(5.0))) == 5
    line = ((F.lit(0.0), F.lit(0.0)), (F.lit(9.0), F.lit(0.0)))
    assert one(camera.line_residual([F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)], F.lit(1.0), F.lit(-7.0), *line)) == 7


def test_tables_points_motion_and_label_lines(spark):
    df = spark.createDataFrame([(1, 5), (2, 6)], "id int, v int")
    assert [r["v"] for r in tables.point(df, "id", 2).collect()] == [6] and tables.point(df, "id", 3).count() == 0
    frames = spark.createDataFrame([(1, 0), (1, 1)], "clip_id int, idx int")
    motion = spark.createDataFrame([(1, 1, [2.0] * 9)], "clip_id int, idx int, h array<double>")
    assert {r["idx"]: r["h"] for r in tables.with_motion(frames, motion).collect()} == {0: [1, 0, 0, 0, 1, 0, 0, 0, 1], 1: [2.0] * 9}
    b = spark.createDataFrame([(3, 10.0, 20.0, 30.0, 60.0, 100, 200)], "cls int, x1 double, y1 double, x2 double, y2 double, w int, h int")
    assert tables.label_lines(b, "cls", ["x1", "y1", "x2", "y2"], "w", "h").first()["line"] == "3 0.200000 0.200000 0.200000 0.200000"
    assert [r["k"] for r in sound.current(spark.createDataFrame([(1, 2), (2, 3)], "k int, version int"), 3).collect()] == [2]


def test_lists_of_matches_and_tracks(spark):
    m = spark.createDataFrame([(1, "2024-01-01", "2024-02-01"), (2, None, "2024-03-01"), (3, "2024-01-01", "2024-02-02")], "id int, date string, created_at string")
    c = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id int, match_id int")
    s = spark.createDataFrame([(1, 7, None, "confirmed", True), (1, None, 1, "confirmed", True), (1, 7, None, "open", True), (1, 7, None, "confirmed", False)], "match_id int, player_id int, team int, status string, goal boolean")
    got = [(r["id"], r["n_clips"], r["score"]) for r in roster.match_list(m, c, s, spark.createDataFrame([(7, 0)], "id int, team int")).collect()]
    assert got == [(2, 1, None), (3, 0, None), (1, 2, [1, 1])]
    t = spark.createDataFrame([(1, 1, None), (1, 2, 9), (1, 3, None)], "clip_id int, track_id int, player_id int")
    v = spark.createDataFrame([(1, 1)], "clip_id int, track_id int")
    ids = lambda **k: sorted(r["track_id"] for r in roster.track_list(t, v, **k).collect())
    assert (ids(), ids(open_only=True), ids(hide_spectators=True)) == ([1, 2, 3], [1, 3], [1, 2])
    clips = spark.createDataFrame([(1, 5, 1), (2, 5, 1), (3, 5, 2)], "id int, match_id int, station int")
    dof = spark.createDataFrame([(1, 9), (2, 9), (3, 4)], "clip_id int, dof int")
    assert {(r["station"], r["clip_id"], r["dof"]) for r in roster.anchors(clips, dof).collect()} == {(1, 1, 9), (2, 3, 4)}


def test_training_examples_by_class(spark):
    rows = [(c, float(t), t % 5 == 0) for c in range(3) for t in range(60)]
    df = spark.createDataFrame(rows, "clip_id int, t double, hard boolean").repartition(4)
    got = roster.training_examples(df, 20, 15).collect()
    assert sum(r["hard"] for r in got) == 20 and sum(not r["hard"] for r in got) == 15
    assert all(r["held_out"] == ((math.floor(r["t"] / 10) + r["clip_id"]) % 7 == 3) for r in got)
    split = roster.split_counts(roster.training_examples(df, 1000, 1000)).first()
    assert split["train"] + split["held_out"] == 180 and split["held_out"] == sum((math.floor(t / 10) + c) % 7 == 3 for c, t, _ in rows)


def test_field_examples(spark):
    frames = [(c, i, i / 10) for c in (1, 2) for i in range(200)]
    keys = [(1, 5.04, False, False, None), (1, 12.0, True, False, 0.5), (1, 15.0, True, True, None), (2, 0.3, True, None, 0.95), (2, 9.0, None, None, None)]
    f, k = spark.createDataFrame(frames, "clip_id int, idx int, t double"), spark.createDataFrame(keys, "clip_id int, t double, auto boolean, accepted boolean, precision double")
    want = set()
    for c, t in ((1, 5.04), (1, 15.0), (2, 0.3)):
        for j in range(-4, 5):
            want.add((c, min(range(200), key=lambda i: (abs(i / 10 - (t + j / 2)), i))))
    got = {(r["clip_id"], r["idx"]) for r in roster.field_examples(f, k).collect()}
    assert got == want
    few = roster.field_examples(f, k, most=5).collect()
    assert len(few) == math.ceil(len(want) / math.ceil(len(want) / 5)) and {(r["clip_id"], r["idx"]) for r in few} <= want


def test_profiles_and_places(spark):
    kind = "squad_id int, name string, match_player_id int, emb string, n int"
    base = spark.createDataFrame([(1, "Ann", 5, "old", 1), (1, "Bo", 6, "old", 1), (None, "X", 7, "old", 1), (None, "Y", 8, "old", 1)], kind)
    new = spark.createDataFrame([(1, " ann ", 9, "new", 2), (None, "X", 7, "new", 2), (2, "Ann", 5, "new", 2)], kind)
    assert sorted((r["squad_id"] or 0, r["name"].strip(), r["emb"]) for r in roster.saved_profiles(base, new).collect()) == [(0, "X", "new"), (0, "Y", "old"), (1, "Bo", "old"), (1, "ann", "new"), (2, "Ann", "new")]
    c = spark.createDataFrame([(1, 50.0, 5.0), (1, 52.0, 6.0), (1, None, 7.0), (2, None, None)], "match_id int, gps_lat double, gps_lon double")
    assert [tuple(r) for r in roster.filmed_at(c).collect()] == [(1, 51.0, 5.5)]


def test_teams_learn_from_corrections(spark):
    rng = np.random.default_rng(1)
    shade = {"red": [50.0, 60.0, 40.0], "blue": [40.0, 10.0, -50.0], "black": [5.0, 0.0, 0.0]}
    rows, k = [], 0
    for name, n in (("red", 6), ("blue", 9), ("black", 8)):
        for _ in range(n):
            rows.append((1, k, [v + rng.normal() for v in shade[name]], 40, None, name == "black", name))
            k += 1
    kind = "clip_id int, track_id int, lab array<double>, n_frames int, manual_team int, excluded boolean, name string"
    out = {r["track_id"]: (r["name"], r["team_auto"]) for r in linking.teams_by_colour(spark.createDataFrame(rows, kind)).collect()}
    assert set(out.values()) in ({("red", 1), ("blue", 0), ("black", 2)}, {("red", 0), ("blue", 1), ("black", 2)})  # still ones in black shape none
    by_hand = [(*r[:4], {0: 0, 20: 1}.get(r[1]), False, r[6]) for r in rows]
    out = {r["track_id"]: (r["name"], r["team_auto"]) for r in linking.teams_by_colour(spark.createDataFrame(by_hand, kind)).collect()}
    assert {v for v in out.values() if v[0] != "blue"} == {("red", 0), ("black", 1)}
    few = spark.createDataFrame([*rows[:2], (1, 90, None, 4, None, False, "none"), (1, 91, [1.0, 2.0, 3.0], 4, None, True, "still")], kind)
    assert {r["track_id"]: r["team_auto"] for r in linking.teams_by_colour(few).collect()} == {0: 0, 1: 0, 90: -1, 91: 2}


def test_farthest_points_and_tallest_box(spark):
    p = spark.createDataFrame([(1, k, float(x), 0.0) for k, x in enumerate((0, 1, 2, 9, 10))], "g int, k int, x double, y double")
    assert sorted(r["k"] for r in grouped.farthest(p.coalesce(1), ["g"], ["x", "y"], 3).collect()) == [0, 2, 4]
    d = spark.createDataFrame([(1, 0, 5, 0.0, 0.0, 5.0, 50.0), (1, 0, 6, 0.0, 0.0, 5.0, 90.0), (1, 0, 7, 0.0, 0.0, 5.0, 99.0)], "clip_id int, idx int, track_id int, x1 double, y1 double, x2 double, y2 double")
    f = spark.createDataFrame([(1, 0, 0.5)], "clip_id int, idx int, t double")
    t = spark.createDataFrame([(1, 5, 9), (1, 6, 9), (1, 7, 8)], "clip_id int, track_id int, player_id int")
    assert [r["track_id"] for r in views.spotlight(d, f, t, 9, 0.0, 1.0).collect()] == [6]


def test_visible_landmarks(spark):
    lines = spark.createDataFrame([("a", 0.0, 1.0, 40.0, 1.0), ("b", 0.0, -5.0, 1.0, -5.0)], "name string, ax double, ay double, bx double, by double")
    h = spark.createDataFrame([(1, 0, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "clip_id int, idx int, h array<double>")
    got = views.visible_landmarks(lines, h, 20.0, 10.0).collect()
    assert {(r["name"], r["px"]) for r in got} == {("a", 0.0), ("a", 5.0), ("a", 10.0), ("a", 15.0), ("a", 20.0)}
