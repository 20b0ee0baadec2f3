"""Camera and homography fits on planted cameras, priors one by one, wrong clicks against plain refits, and degenerate keyframes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmill.operators import calibration as cal

SIZE = (1920.0, 1080.0)
#: Places of a pitch of 105 by 68 metres that cameras see.
PLACES = [(0, 0), (52.5, 0), (105, 0), (0, 68), (52.5, 68), (105, 68), (16.5, 13.84), (16.5, 54.16), (88.5, 13.84), (88.5, 54.16), (11, 34), (94, 34), (52.5, 34), (5.5, 24.84), (99.5, 43.16)]
LINES = [((0, 0), (105, 0)), ((0, 68), (105, 68)), ((52.5, 0), (52.5, 68)), ((0, 0), (0, 68)), ((16.5, 13.84), (16.5, 54.16))]


def plain_seen(camera, at):
    """One world point (along, across, up) through one camera, by the angles' definition: image place and depth."""
    x, y, height, yaw, tilt, roll, log_f = camera
    ahead = np.array([math.cos(yaw) * math.cos(tilt), math.sin(yaw) * math.cos(tilt), math.sin(tilt)])
    right = np.array([-math.sin(yaw), math.cos(yaw), 0.0])
    down = np.cross(ahead, right)
    right, down = math.cos(roll) * right + math.sin(roll) * down, math.cos(roll) * down - math.sin(roll) * right
    v = np.array([at[0] - x, at[1] - y, -at[2] + height])
    return math.exp(log_f) * (right @ v) / (ahead @ v) + SIZE[0] / 2, math.exp(log_f) * (down @ v) / (ahead @ v) + SIZE[1] / 2, ahead @ v


def planted(rng):
    x, y = rng.uniform(20, 85), rng.choice([-1, 1]) * rng.uniform(38, 60) + 34
    yaw = math.atan2(34 - y, rng.uniform(30, 75) - x)
    return [x, y, rng.uniform(1.5, 9), yaw, rng.uniform(0.02, 0.2), rng.uniform(-0.05, 0.05), math.log(rng.uniform(900, 2400))]


def clicks_of(camera, rng, points=6, lines=2, high=0, noise=0.0):
    shown = [(p, plain_seen(camera, (*p, 0.0))) for p in PLACES]
    shown = [(p, q) for p, q in shown if q[2] > 1 and -600 < q[0] < 2500 and -600 < q[1] < 1700]
    rng.shuffle(shown)
    out = [{"x": q[0] + rng.normal(0, noise), "y": q[1] + rng.normal(0, noise), "px": float(p[0]), "py": float(p[1])} for p, q in shown[:points]]
    for a, b in LINES:
        on = [np.array(a) + t * (np.array(b) - np.array(a)) for t in rng.uniform(0, 1, 20)]
        on = [(p, plain_seen(camera, (*p, 0.0))) for p in on]
        on = [q for _, q in on if q[2] > 1 and 0 < q[0] < 1920 and 0 < q[1] < 1080][:2]
        if len(on) == 2 and lines > 0:
            lines -= 1
            out += [{"x": q[0], "y": q[1], "ax": float(a[0]), "ay": float(a[1]), "bx": float(b[0]), "by": float(b[1])} for q in on]
    for p in [(0, 30.34), (0, 37.66), (105, 30.34), (105, 37.66)]:
        q = plain_seen(camera, (*p, 2.44))
        if q[2] > 1 and high > 0:
            high -= 1
            out.append({"x": q[0], "y": q[1], "px": float(p[0]), "py": float(p[1]), "up": 2.44})
    return out


def prior_of(camera, rng, place=0.0):
    return {"x": camera[0] + rng.normal(0, place), "y": camera[1] + rng.normal(0, place), "height": camera[2], "focal": math.exp(camera[6]), "uncertain": 4.0, "yaw": None}


def fits(rows, known, search=False):
    return cal.calibrated(rows, np.tile(SIZE, (len(rows), 1)), known, search)


def test_projection_equals_the_definition():
    rng = np.random.default_rng(1)
    for _ in range(50):
        c = planted(rng)
        c[5] = rng.uniform(-1, 1)
        at = rng.uniform([0, 0, 0], [105, 68, 3], (9, 3))
        got = cal.seen(np.array(c), at * [1, 1, -1], np.array(SIZE))
        for p, q in zip(at, got, strict=True):
            x, y, depth = plain_seen(c, p)
            assert q[2] == pytest.approx(depth)
            assert q[:2] / q[2] == pytest.approx([x, y], rel=1e-9)
        h = cal.ground_homography(np.array(c), np.array(SIZE))
        v = h @ [30.0, 20.0, 1.0]
        assert v[:2] / v[2] == pytest.approx(plain_seen(c, (30, 20, 0))[:2], rel=1e-9)


def test_planted_cameras_are_recovered():
    rng = np.random.default_rng(2)
    cameras = [planted(rng) for _ in range(40)]
    rows = [clicks_of(c, rng, high=2) for c in cameras]
    got = fits(rows, [prior_of(c, rng) for c in cameras])
    good = [g for g, r in zip(got, rows, strict=True) if len(r) >= 6]
    assert len(good) > 30
    for g, c, r in zip(got, cameras, rows, strict=True):
        if len(r) < 6:
            continue
        assert g["camera"][:3] == pytest.approx(c[:3], abs=0.02)
        assert math.cos(g["camera"][3] - c[3]) == pytest.approx(1, abs=1e-6)
        assert g["camera"][4:] == pytest.approx(c[4:], abs=2e-3)
        assert g["mean_pixels"] < 0.2 and g["fits"] and g["error"] < 0.2


def test_two_clicks_and_a_known_place_suffice():
    rng = np.random.default_rng(3)
    cameras = [planted(rng) for _ in range(12)]
    for c in cameras:
        c[5] = 0.0
    rows = [clicks_of(c, rng, points=2, lines=0) for c in cameras]
    for g, c, r in zip(fits(rows, [prior_of(c, rng) for c in cameras]), cameras, rows, strict=True):
        if len(r) == 2:
            assert g["model"] == "camera" and g["mean_pixels"] < 1
            assert g["camera"][:3] == pytest.approx(c[:3], abs=1.0)


@pytest.mark.parametrize(("k", "step", "want"), [(0, 5.0, 1.0), (1, -10.0, -2.0), (2, 0.5, 1.0), (5, math.radians(8), 2.0), (6, math.log(2.2), 1.0)])
def test_priors_one_by_one(k, step, want):
    prior = np.array([[50.0, 80, 3, 1000, 5, np.nan]])
    camera = np.array([[50.0, 80, 3, 0.4, 0.1, 0, math.log(1000)]])
    assert cal.prior_errors(camera, prior) == pytest.approx(np.zeros((1, 6)), abs=1e-12)
    camera[0, k] += step
    e = cal.prior_errors(camera, prior)[0]
    assert sorted(np.abs(e))[:5] == pytest.approx([0] * 5, abs=1e-12)
    assert e.sum() == pytest.approx(want)


def test_prior_of_the_direction_wraps_and_places_are_three_metres_at_least():
    prior = np.array([[0.0, 0, 3, 1000, 1, math.radians(179)]])
    camera = np.array([[6.0, 0, 3, math.radians(-179), 0.1, 0, math.log(1000)]])
    assert cal.prior_errors(camera, prior)[0] == pytest.approx([2, 0, 0, 0, 0, 2 / 15])


def test_clicks_behind_the_camera_cost_most():
    c = np.array([[50.0, 100, 3, -math.pi / 2, 0.1, 0, math.log(1000)]])
    rows = [[{"x": 5.0, "y": 5.0, "px": 50.0, "py": 140.0}, {"x": 5.0, "y": 5.0, "px": 50.0, "py": 140.0, "up": 2.0}, {"x": 1.0, "y": 1.0, "ax": 0.0, "ay": 140.0, "bx": 9.0, "by": 140.0, "up": 2.0}]]
    clicks = cal.Clicks(rows, np.array([SIZE]))
    e = cal.click_errors(c, clicks) / cal.CLICK_PX
    assert e[0].tolist() == [[1000, 1000], [1000, 1000], [1000, 0]]


def test_free_fits_with_lines_recover_the_view():
    rng = np.random.default_rng(4)
    cameras = [planted(rng) for _ in range(30)]
    rows = [clicks_of(c, rng, points=4, lines=4) for c in cameras]
    n = 0
    for g, c, r in zip(fits(rows, [None] * 30), cameras, rows, strict=True):
        if sum("px" in p for p in r) < 4:
            continue
        n += 1
        assert g["model"] == "free" and g["camera"] is None
        assert g["error"] < 1e-3 and g["mean_pixels"] < 1e-2
        h = np.array(g["h"]).reshape(3, 3)
        for p in r:
            q = h @ [p["x"], p["y"], 1]
            assert q[2] > 0
        x, y, depth = plain_seen(c, (52.5, 34, 0))
        if depth > 1:
            q = h @ [x, y, 1]
            assert q[:2] / q[2] == pytest.approx([52.5, 34], abs=0.05)
    assert n > 20


def test_zoomed_clicks_count_more():
    rng = np.random.default_rng(5)
    c = planted(rng)
    r = clicks_of(c, rng, points=8, lines=0)
    r[0]["x"] += 30
    plain = fits([r], [None])[0]
    r[0]["zoom"] = 9.0  # four at most
    close = fits([r], [None])[0]
    assert close["pixels"][0] < plain["pixels"][0]


def test_wrong_clicks_are_named_and_equal_plain_refits():
    rng = np.random.default_rng(6)
    rows, known, wrong, cameras = [], [], [], []
    while len(rows) < 12:
        c = planted(rng)
        r = clicks_of(c, rng, points=7, lines=0, noise=0.3)
        if len(r) < 7:
            continue
        k = int(rng.integers(0, len(r)))
        r[k]["x"] += 220
        rows.append(r)
        wrong.append(k)
        cameras.append(c)
        known.append(prior_of(c, rng))
    got = fits(rows, known, search=True)
    assert sum(g["suspect"] == k for g, k in zip(got, wrong, strict=True)) >= 11
    assert all(g["suspect"] in (k, None) for g, k in zip(got, wrong, strict=True))
    clicks = cal.Clicks(rows, np.tile(SIZE, (len(rows), 1)))
    prior = cal.priors(known, len(rows))
    spread = cal.without_each(clicks, prior, np.array([g["camera"] for g in got]))
    for i in range(4):  # a fit of its own for each omitted click
        for k in range(len(rows[i])):
            rest = cal.Clicks([rows[i][:k] + rows[i][k + 1 :]], np.array([SIZE]))
            near = prior[i : i + 1].copy()
            near[0, 5] = got[i]["camera"][3]
            found = cal.fitted_cameras(rest, near)
            pixels = cal.click_errors(found, rest)[rest.use]
            plain = math.sqrt((pixels**2).mean())
            assert spread[i, k] <= plain + 0.05
            assert spread[i, k] == pytest.approx(plain, abs=0.1) or spread[i, k] < plain
    clean = [clicks_of(c, rng, points=7, lines=0, noise=0.3) for c in cameras]
    assert all(g["suspect"] is None for g in fits(clean, known, search=True))


def test_wrong_click_of_a_free_fit():
    rng = np.random.default_rng(7)
    done = 0
    while done < 6:
        c = planted(rng)
        r = clicks_of(c, rng, points=8, lines=0)
        if len(r) < 8:
            continue
        r[3]["y"] += 150
        g = fits([r], [None], search=True)[0]
        assert g["suspect"] in (3, None)
        done += g["suspect"] == 3
    assert done == 6


def test_the_free_fit_wins_only_by_half():
    rng = np.random.default_rng(8)
    c = planted(rng)
    while len(clicks_of(c, rng, points=8, lines=0)) < 8:
        c = planted(rng)
    r = clicks_of(c, rng, points=8, lines=0)
    lost = {"x": c[0] + 60, "y": c[1], "height": 1.0, "focal": 5000.0, "uncertain": 3.0, "yaw": None}
    g = fits([r], [lost])[0]
    assert (g["model"] == "free") == (g["free_error"] < 0.5 * g["camera_error"])
    g = fits([r], [prior_of(c, rng)])[0]
    assert g["free_error"] is not None and g["camera_error"] is not None


def test_mirrored_clicks_are_turned_back_or_refused():
    """Clicks on the halfway line, side lines and circle fit the pitch and its mirror image."""
    camera = [52.5, 90.0, 6.0, -math.pi / 2, 0.15, 0.0, math.log(1100)]
    rng = np.random.default_rng(9)
    swapped = [dict(p, px=105 - p["px"]) for p in clicks_of(camera, rng, points=9, lines=0)]
    g = fits([swapped], [None])[0]
    assert (g["reason"] == "mirrored" and g["h"] is None) or np.linalg.det(np.array(g["h"]).reshape(3, 3)) > 0


def test_degenerate_keyframes_have_a_reason():
    point = {"x": 1.0, "y": 2.0, "px": 3.0, "py": 4.0}
    row = [dict(point, x=float(k), px=float(k)) for k in range(5)]  # all on one line
    got = fits([[], [point], row, [dict(point, x=None)], [{"x": 1.0, "y": 1.0}]], [None] * 5)
    assert [g["reason"] for g in got] == ["too little", "too little", "undetermined", "too little", "too little"]
    assert all(g["h"] is None and g["model"] is None for g in got)


def test_freedom():
    line = {"ax": 0.0, "ay": 0.0, "bx": 9.0, "by": 0.0}
    rows = [[{"x": 1.0, "y": 1.0, "px": 0.0, "py": 0.0}] * 2 + [dict(line, x=float(k), y=0.0) for k in range(3)] + [{"x": 1.0, "y": 1.0, "ax": 0.0, "ay": 5.0, "bx": 9.0, "by": 5.0}, {"x": 1.0, "y": 1.0, "px": 0.0, "py": 0.0, "up": 2.0}]]
    clicks = cal.Clicks(rows, np.array([SIZE]))
    assert (clicks.freedom(False).tolist(), clicks.freedom(True).tolist()) == ([7], [9])


CLICKS = "array<struct<x: double, y: double, px: double, py: double, ax: double, ay: double, bx: double, by: double, up: double, zoom: double>>"


def test_fits_as_a_dataframe(spark):
    rng = np.random.default_rng(10)
    cameras = [planted(rng) for _ in range(9)]
    rows = [(k, [tuple(None if p.get(f) is None else float(p[f]) for f in cal.CLICK_FIELDS) for p in clicks_of(c, rng)], tuple(None if v is None else float(v) for v in prior_of(c, rng).values()), 1920, 1080, "old") for k, c in enumerate(cameras)]
    rows += [(90, None, None, 1920, 1080, "old"), (91, [], None, 1920, 1080, None), (92, [None], (1.0, 1.0, None, None, None, None), 1920, 1080, None)]
    df = spark.createDataFrame(rows, f"id int, clicks {CLICKS}, prior struct<x: double, y: double, height: double, focal: double, uncertain: double, yaw: double>, width int, height int, fit string")
    got = {r["id"]: r["fit"] for r in cal.fit_keyframes(df.repartition(3), search=False).collect()}
    alone = {r["id"]: r["fit"] for r in cal.fit_keyframes(df.coalesce(1), search=False, at_once=1).collect()}
    assert len(got) == 12
    for k, c in enumerate(cameras):
        if len(rows[k][1]) >= 6:
            assert got[k]["camera"][:3] == pytest.approx(c[:3], abs=0.05)
        assert got[k]["camera"] == pytest.approx(alone[k]["camera"], rel=1e-6)
    assert [got[k]["reason"] for k in (90, 91, 92)] == ["too little"] * 3
    assert cal.fit_keyframes(df.limit(0)).count() == 0
    assert cal.fit_keyframes(df, prior=None, search=False).where(F.col("fit.model") == "camera").count() == 0


def test_small_rows_are_fitted_by_many_tasks(spark):
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    df = spark.range(64).coalesce(1).select("id", F.array(*map(F.lit, eye)).alias("h"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.expr("cast(null as array<struct<x: double, y: double>>)").alias("clicks"))
    for out in (cal.inverse_cameras(df), cal.fit_keyframes(df, prior=None)):
        rows = out.select("id", F.spark_partition_id().alias("task")).collect()
        assert sorted(r["id"] for r in rows) == list(range(64)) and len({r["task"] for r in rows}) >= 4


def test_points_cost_the_same_with_and_without_a_line(spark):
    rng = np.random.default_rng(2)
    point = [{"x": x, "y": y, "px": p, "py": q} for x, y, p, q in rng.uniform(0, 60, (7, 4))]
    line = {"x": 1.0, "y": 2.0, "ax": 0.0, "ay": 0.0, "bx": 9.0, "by": 1.0}
    camera, size = rng.uniform(0.1, 1.0, (1, 7)) + [0, 0, 3, 0, 0, 0, 6], np.array([[1920.0, 1080.0]])
    alone, mixed = (cal.click_errors(camera, cal.Clicks([c], size)) for c in (point, [*point, line]))
    assert np.allclose(alone[0], mixed[0, :7], rtol=1e-12) and alone.any()
