"""Relay paths against Dijkstra, fix points against a plain loop, inverse cameras, plausibility, and calibrations carried from clip to clip."""

import heapq
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmill.operators import calibration as cal
from trackmill.operators import rounds
from trackmill.plans import stations

SIZE = np.array([1920.0, 1080.0])


def dijkstra(edges, seeds):
    """Least (cost, nodes, path) of every node."""
    best, queue = {}, [(c, 1, (n,)) for n, c in seeds]
    heapq.heapify(queue)
    while queue:
        c, n, path = heapq.heappop(queue)
        if path[-1] in best:
            continue
        best[path[-1]] = (c, path)
        for a, b, w in edges:
            if a == path[-1]:
                heapq.heappush(queue, (c + w, n + 1, (*path, b)))
    return best


def test_paths_equal_dijkstra_on_random_graphs(spark):
    rng = random.Random(1)
    edges, seeds, want = [], [], {}
    for g in range(6):
        nodes = range(rng.randint(2, 14))
        own = [(a, b, float(rng.choice([0, 1, 1, 2, 5, 9]))) for a in nodes for b in nodes if rng.random() < 0.25]
        start = {n: float(rng.choice([0, 3])) for n in nodes if rng.random() < 0.3}
        edges += [(g, *e) for e in own]
        seeds += [(g, n, c) for n, c in start.items()]
        want |= {(g, n): v for n, v in dijkstra(own, start.items()).items()}
    e = spark.createDataFrame([*edges, (0, None, 1, 1.0), (0, 1, None, 1.0), (0, 0, 1, None)], "m int, src int, dst int, cost double")
    s = spark.createDataFrame([*seeds, (0, None, 1.0), (1, 2, None)], "m int, node int, cost double")
    got = {(r["m"], r["node"]): (r["cost"], tuple(r["path"])) for r in rounds.shortest_paths(e, s, ["m"]).collect()}
    assert got == want
    near = {(r["m"], r["node"]) for r in rounds.shortest_paths(e, s, ["m"], reach=3.0).collect()}
    assert near == {k for k, v in want.items() if v[0] <= 3}
    assert rounds.shortest_paths(e, s.limit(0), ["m"]).count() == 0


def test_fix_point_equals_a_loop(spark):
    rng = random.Random(2)
    links = {(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(45)}
    df = spark.createDataFrame(sorted(links), "a int, b int")
    got = rounds.fix_point(spark.createDataFrame([(0, 0), (None, 0)], "n int, round int"), lambda new, _: df.join(new.select(F.col("n").alias("a"), "round"), "a").groupBy(F.col("b").alias("n")).agg((F.min("round") + 1).alias("round")), ["n"])
    level = {0: 0}
    for k in itertools.count():
        more = {b for a, b in links if level.get(a) == k} - level.keys()
        if not more:
            break
        level |= dict.fromkeys(more, k + 1)
    rows = got.collect()
    assert {r["n"]: r["round"] for r in rows if r["n"] is not None} == level
    assert len(rows) == len(level) + 1


def a_camera(rng, x=50.0, y=82.0, height=3.0, yaw=None):
    return np.array([x, y, height, -math.pi / 2 + rng.uniform(-0.5, 0.5) if yaw is None else yaw, rng.uniform(0.04, 0.12), rng.uniform(-0.03, 0.03), math.log(rng.uniform(1000, 1600))])


def view_of(c):
    """Image-to-pitch matrix of a camera, positive where the image's lower middle is."""
    k = np.linalg.inv(cal.ground_homography(c[None], SIZE[None]))[0]
    return k * np.sign((k @ [960, 1000, 1])[2]) / abs(k[2, 2])


def test_cameras_behind_their_views():
    rng = np.random.default_rng(3)
    cameras = np.array([a_camera(rng, rng.uniform(10, 95), rng.choice([-14.0, 82.0]), rng.uniform(2, 8)) for _ in range(40)])
    cameras[:, 3] = np.where(cameras[:, 1] < 0, -cameras[:, 3], cameras[:, 3])
    got, error = cal.cameras_behind(np.array([view_of(c) for c in cameras]), np.tile(SIZE, (40, 1)))
    seen = ~np.isnan(error)
    assert seen.sum() >= 36 and (error[seen] < 0.5).all()
    assert np.abs(got[seen][:, :3] - cameras[seen][:, :3]).max() < 0.2
    assert np.abs(got[seen][:, 6] - cameras[seen][:, 6]).max() < 0.02


def test_plausible_views_stand_at_the_station():
    rng = np.random.default_rng(4)
    station = a_camera(rng)
    turned = [a_camera(rng, *station[:3]) for _ in range(10)]
    for c in turned:
        c[6] = station[6] + rng.uniform(-0.4, 0.8)
    beside = [a_camera(rng, station[0] + 3, station[1] + 1, station[2] + 0.5)]
    far = [a_camera(rng, station[0] - 40, station[1] + 3, station[2] + 5)]
    mirror = np.diag([-1.0, 1, 1])
    mirror[0, 2] = 105
    views = [*map(view_of, [*turned, *beside, *far]), mirror @ view_of(turned[0])]
    ok, camera, error = cal.plausible_views(np.array(views), np.tile(station, (len(views), 1)), np.tile(SIZE, (len(views), 1)))
    assert ok.tolist() == [True] * 11 + [False, False]
    assert (error[:10] < 1).all() and np.abs(camera[:10, 3] - np.array(turned)[:, 3]).max() < 0.01


def test_views_as_dataframes(spark):
    rng = np.random.default_rng(5)
    station = a_camera(rng)
    good = view_of(a_camera(rng, *station[:3]))
    rows = [(1, good.ravel().tolist(), station.tolist()), (2, None, station.tolist()), (3, [0.0] * 9, station.tolist()), (4, good.ravel().tolist(), None), (5, [1.0], [2.0])]
    df = spark.createDataFrame([(*r, 1920, 1080, "old") for r in rows], "id int, h array<double>, station_camera array<double>, width int, height int, view string")
    got = {r["id"]: r["view"] for r in cal.plausible(df).collect()}
    assert {k: v["ok"] for k, v in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    back = {r["id"]: r["seen_by"]["error"] for r in cal.inverse_cameras(df).collect()}
    assert back[1] < 0.5 and [back[k] for k in (2, 3, 5)] == [None] * 3


def clip_of(rng, station, clip, n, yaw):
    """n frames of a clip that turns: (t, camera, motion to its first frame)."""
    first = a_camera(rng, *station[:3], yaw=yaw)
    out = []
    for k in range(n):
        c = first.copy()
        c[3] += 0.12 * k
        m = cal.ground_homography(first[None], SIZE[None])[0] @ view_of(c)
        out.append((clip, float(k), c, m / abs(m[2, 2]) * np.sign((m @ [960, 540, 1])[2])))
    return out


def test_calibrations_are_carried_in_rounds(spark):
    """Clip 1 is calibrated by hand; 2 shares an image with 1, 3 with 2 only, 4 with none, 5 with 1 but from elsewhere."""
    rng = np.random.default_rng(6)
    station = a_camera(rng)
    clips = {k: clip_of(rng, station, k, 4, -math.pi / 2 + 0.15 * k) for k in (1, 2, 3, 4)}
    clips[5] = clip_of(rng, a_camera(rng, station[0] - 40, station[1] + 8, station[2] + 6), 5, 4, -math.pi / 2)
    frames = [(k, t, m.ravel().tolist(), 1920, 1080) for fs in clips.values() for k, t, _, m in fs]

    def match(a, i, b, j, n):
        m = cal.ground_homography(clips[b][j][2][None], SIZE[None])[0] @ view_of(clips[a][i][2])
        return (7, a, float(i), b, float(j), (m / abs(m[2, 2]) * np.sign((m @ [960, 900, 1])[2])).ravel().tolist(), n)

    matches = [match(2, 0, 1, 1, 80), match(2, 1, 1, 3, 60), match(2, 2, 1, 2, 20), match(3, 1, 2, 3, 90), match(3, 0, 2, 0, 40), match(5, 0, 1, 1, 200)]
    df = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = stations.calibrate(
        df([(7, 1, 0.0, view_of(clips[1][0][2]).ravel().tolist(), 0.0)], "station int, clip_id int, t double, h array<double>, turn double"),
        df(frames, "clip_id int, t double, a array<double>, width int, height int"),
        df(matches, "station int, clip_id int, t double, ref_clip int, ref_t double, m array<double>, inliers int"),
        df([(7, station.tolist())], "station int, station_camera array<double>"),
    ).collect()
    assert {(r["clip_id"], r["t"], r["round"], r["method"]) for r in got} == {(1, 0.0, 0, "hand"), (2, 0.0, 1, "surroundings"), (3, 1.0, 2, "surroundings")}
    for r in got:
        want = view_of(clips[r["clip_id"]][int(r["t"])][2])
        h = np.array(r["h"]).reshape(3, 3)
        a, b = h @ [960, 900, 1], want @ [960, 900, 1]
        assert a[:2] / a[2] == pytest.approx(b[:2] / b[2], abs=0.02)
    turn = {r["clip_id"]: r["turn"] for r in got}
    assert turn[1] == 0 and turn[2] == pytest.approx(math.degrees(0.12), abs=2)
    assert turn[3] > turn[2]


def test_relays_save_turns(spark):
    """A reference 60 degrees from its keyframe takes the calibration of one in another clip that looks its way."""
    rng = np.random.default_rng(7)
    near, far = a_camera(rng, yaw=-math.pi / 2), a_camera(rng, yaw=-math.pi / 2 + 0.1)
    far[3] = near[3] + math.radians(4)
    refs = [(7, 1, 0.0, view_of(near).ravel().tolist(), 5.0, 1920, 1080), (7, 2, 0.0, (view_of(far) * 1.03).ravel().tolist(), 60.0, 1920, 1080), (7, 3, 0.0, view_of(near).ravel().tolist(), 50.0, 1920, 1080)]
    m = cal.ground_homography(near[None], SIZE[None])[0] @ view_of(far)
    rows = [(7, 2, 0.0, 1, 0.0, (m * np.sign((m @ [960, 900, 1])[2])).ravel().tolist(), 100), (7, 3, 0.0, 1, 0.0, np.eye(3).ravel().tolist(), 59)]
    out = stations.relayed(
        spark.createDataFrame(refs, "station int, clip_id int, t double, h array<double>, turn double, width int, height int"),
        spark.createDataFrame(rows, "station int, clip_id int, t double, ref_clip int, ref_t double, m array<double>, inliers int"),
    )
    got = {r["clip_id"]: r for r in out.collect()}
    assert got[1]["turn"] == 5.0 and got[3]["turn"] == 50.0
    assert got[2]["turn"] == pytest.approx(9, abs=1)
    a, b = np.array(got[2]["h"]).reshape(3, 3) @ [960, 900, 1], view_of(far) @ [960, 900, 1]
    assert a[:2] / a[2] == pytest.approx(b[:2] / b[2], abs=0.01)


def test_overview(spark):
    clips = [(1, 7, "done", None, 100.0), (2, 7, "done", "approved", 10.0), (3, 7, "new", None, None), (4, 7, "done", "rejected", 10.0), (5, 8, "done", None, 10.0), (6, 8, "done", None, 10.0)]
    keys = [(1, 10.0, False, None, False, None, None, None, None), (2, 5.0, True, "station", False, "surroundings", True, False, 50.0), (5, 5.0, True, "station", False, "surroundings", False, True, 47.4), (5, 6.0, True, "station", False, "lines", False, False, 3.0)]
    out = stations.overview(
        spark.createDataFrame(clips, "id int, station int, status string, review string, duration double"),
        spark.createDataFrame(keys, "clip_id int, t double, auto boolean, source string, bad boolean, method string, lines boolean, unsure boolean, turn double"),
        spark.createDataFrame([(7, 1, 50.04, 82.0, 3.0)], "station int, clip_id int, x double, y double, height double"),
    )
    got = {r["clip_id"]: r for r in out.collect()}
    assert [got[k]["state"] for k in range(1, 7)] == ["own", "approved", "not analysed", "rejected", None, "open"]
    assert [got[k]["uncertain"] for k in (1, 2, 5)] == [False, True, True]
    assert got[1]["coverage"] == 0.1 and got[1]["confidence"] == round(95 * 0.64) and got[2]["confidence"] == 97
    assert got[4]["confidence"] is None and got[6]["confidence"] is None and got[5]["turn_deg"] == 47
    assert (got[1]["anchor_clip"], got[1]["anchor_x"], got[5]["anchor_clip"]) == (1, 50.0, None)
