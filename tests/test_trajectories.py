"""Domain cases with the reference's numbers, rewrites against plain loops, plans without cross products."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmill.functions import geometry, parsing, vectors
from trackmill.operators import choose, grouped, sequences, timejoins
from trackmill.plans import domain_queries, match
from trackmill.sources import tables
from trackmill.streaming import windows

POS = "clip_id int, idx int, t double, entity string, team int, x double, y double, fps double"


def test_distance_speed_and_sprint(spark):
    rows = [(1, i, i / 10, "p1", 0, 10 + 8 * i / 10, 30.0, 10.0) for i in range(100)]
    r = match.movement(spark.createDataFrame(rows, POS)).first()
    assert abs(r["distance"] - 79.2) < 1 and abs(r["max_speed"] - 8) < 0.2 and r["sprints"] == 1


def test_gap_is_no_distance(spark):
    rows = [(1, i, i / 10, "p1", 0, 10.0, 30.0, 10.0) for i in range(20)] + [(1, 100 + i, 10 + i / 10, "p1", 0, 60.0, 30.0, 10.0) for i in range(20)]
    assert match.movement(spark.createDataFrame(rows, POS)).first()["distance"] < 0.5


def test_possession_and_passes(spark):
    rows, ball = [], []
    for i in range(60):
        rows += [(1, i, i / 10, f"p{k}", int(k == 3), 20.0 * k, 30.0, 10.0) for k in (1, 2, 3)]
        ball.append((1, i, i / 10, 20.0 * (1 + i // 20), 30.0))
    pos, b = spark.createDataFrame(rows, POS), spark.createDataFrame(ball, "clip_id int, idx int, t double, x double, y double")
    runs = match.possessions(pos, b)
    assert [r["entity"] for r in runs.orderBy("t0").collect()] == ["p1", "p2", "p3"]
    assert [(r["from_owner"], r["to_owner"], r["ok"]) for r in match.match_passes(runs).orderBy("t").collect()] == [("p1", "p2", 1), ("p2", "p3", 0)]
    assert match.statistics(pos, b).count() == 3


def test_heat_map_seconds(spark):
    rows = [(1, i, i / 10, "p1", 0, 52.5, 34.0, 10.0) for i in range(10)] + [(1, 99, 9.9, "p1", 0, 105.0, 68.0, 10.0), (1, 100, 10.0, "p1", 0, 106.0, 1.0, 10.0)]
    out = match.heat_map(spark.createDataFrame(rows, POS)).collect()
    assert sum(r["seconds"] for r in out) == pytest.approx(1.1) and (13, 20) in {(r["by"], r["bx"]) for r in out}


def test_ball_jump_and_off_pitch_go(spark):
    rows = [(1, i, i / 10, 50.0 + i, 30.0, "found") for i in range(10)]
    rows[3], rows[7] = (1, 3, 0.3, 90.0, 60.0, "found"), (1, 7, 0.7, 57.0, 90.0, "found")
    out = match.cleaned_ball(spark.createDataFrame(rows, "clip_id int, idx int, t double, x double, y double, kind string"))
    assert sorted(r["idx"] for r in out.collect()) == [0, 1, 2, 4, 5, 6, 8, 9]


def test_smoothing_equals_a_padded_convolution(spark):
    rng = random.Random(1)
    for n in (2, 3, 4, 5, 6, 9):
        v = [rng.randint(0, 99) for _ in range(n)]
        out = sequences.smoothed(spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "k int, i int, v int"), ["k"], ["i"], "v").orderBy("i").collect()
        w = min(5, n)
        padded = np.pad(np.array(v, float), (w // 2, w - 1 - w // 2), mode="edge")
        assert np.allclose([r["smooth_sum"] / r["smooth_n"] for r in out], np.convolve(padded, np.ones(w) / w, "valid"))


def test_despike_equals_the_sequential_rule(spark):
    rng, rows = random.Random(2), []
    for k in range(60):
        rows += [(k, i, rng.choice([0, 1, 2, 90, 91])) for i in range(12)]
    out = sequences.despiked(spark.createDataFrame(rows, "k int, i int, v int"), ["k"], ["i"], "i", "v", 40, 1).collect()
    got = {(r["k"], r["i"]) for r in out if r["spike"]}
    want = set()
    for k in range(60):
        v = [x for a, _, x in rows if a == k]
        gone = set()
        for i in range(1, 11):
            if i - 1 not in gone and abs(v[i] - v[i - 1]) > 40 and abs(v[i + 1] - v[i]) > 40 and not abs(v[i + 1] - v[i - 1]) > 80:
                gone.add(i)
        want |= {(k, i) for i in gone}
    assert got == want


def test_suppression_equals_the_greedy_loop(spark):
    rng = random.Random(3)
    rows = [(k, rng.randint(0, 300), s, k * 100 + s) for k in range(20) for s in range(15)]
    got = {(r["k"], r["i"]) for r in choose.suppressed(spark.createDataFrame(rows, "k int, t long, s int, i long"), ["k"], "t", "s", "i", 30).collect()}
    want = set()
    for k in range(20):
        kept = []
        for _, t, s, i in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1], r[3])):
            if all(abs(t - u) >= 30 for u in kept):
                kept.append(t)
                want.add((k, i))
    assert got == want


def test_suppression_in_dense_streams(spark):
    rng = random.Random(4)
    rows = [(1, t, rng.randint(0, 40), t % 7) for t in range(-700, 700)]  # one stream without a gap, scores tie
    rows += [(2, 5 * t, t, 0) for t in range(80)] + [(3, 5 * t, -t, 0) for t in range(80)]  # rising, falling
    rows += [(None, t, rng.randint(0, 3), t) for t in range(0, 200, 3)] + [(4, 10, 5, 1)] * 3  # a null key, repeated rows
    schema = "k int, t long, s int, i long"
    for apart in (1, 30, 1000):
        want = []
        for k in (1, 2, 3, 4, None):
            kept = []
            for _, t, s, i in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1], r[3])):
                if all(abs(t - u) >= apart for u in kept):
                    kept.append(t)
                    want.append((k, t, s, i))
        got = [tuple(r) for r in choose.suppressed(spark.createDataFrame(rows, schema), ["k"], "t", "s", "i", apart).collect()]
        assert sorted(got, key=str) == sorted(want, key=str), apart
    lost = [(1, None, 9, 1), (1, None, 8, 2), (1, 4, None, 3), (1, 5, 7, 4)]
    got = {tuple(r) for r in choose.suppressed(spark.createDataFrame(lost, schema), ["k"], "t", "s", "i", 30).collect()}
    assert got == {(1, None, 9, 1), (1, None, 8, 2), (1, 4, None, 3)}
    assert choose.suppressed(spark.createDataFrame([], schema), ["k"], "t", "s", "i", 30).count() == 0


def test_caps_of_classes(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "c", None]), rng.randint(0, 9), i) for i in range(400)]
    df = spark.createDataFrame(rows, "label string, v int, i int")
    got = {tuple(r) for r in choose.stratified(df, "label", [F.desc("v"), "i"], {"a": 7, "b": 1000, "d": 3, "c": 0}).collect()}
    want = set()
    for k, n in (("a", 7), ("b", 1000)):
        first = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))[:n]
        want |= {(*r, j + 1) for j, r in enumerate(first)}
    assert got == want
    assert choose.stratified(df, "label", ["i"], {}).count() == 0


def test_chains_and_pairs(spark):
    c = spark.createDataFrame([(1, 1, 2, 0.1), (1, 1, 3, 0.2), (1, 2, 4, 0.3), (1, 3, 4, 0.4)], "clip int, a int, b int, cost double")
    assert {(r["track"], r["root"]) for r in grouped.chains(c, ["clip"], "a", "b", "cost").collect()} == {(1, 1), (2, 1), (3, 3), (4, 1)}
    p = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 1, 0.7), (1, 2, 2, 0.6)], "f int, l int, r int, s double")
    assert {(r["l"], r["r"]) for r in grouped.greedy_pairs(p, ["f"], "l", "r", "s").collect()} == {(1, 1), (2, 2)}


def test_stations(spark):
    rows = [("a", 0.0, 0.0, 3.0, 0.0), ("b", 9.0, 0.0, 12.0, 100.0), ("c", 60.0, 0.0, 4.0, 5000.0), ("d", None, None, None, 5100.0), ("e", None, None, None, None)]
    out = {r["id"]: r["station"] for r in grouped.stations(spark.createDataFrame([(1, *r) for r in rows], "m int, id string, e double, n double, acc double, t double"), ["m"], "e", "n", "acc", "t").collect()}
    assert out["a"] == out["b"] != out["c"] == out["d"] != out["e"] and out["e"] not in (out["a"], out["c"])


def test_station_groups_take_every_event(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, datetime.datetime(2024, 1, 1 + i % 2, 0, 0, rng.randrange(30)), rng.randrange(200), rng.choice(["view", "click"]), rng.randrange(40_000) / 100) for i in range(301)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    want, found = {}, {}
    for i, ts, user, kind, value in sorted(rows, key=lambda r: (r[1], r[0])):
        groups = found.setdefault((kind, ts.date()), [])
        x, y = round(value * 100) % 500, user % 90
        near = [(math.hypot(x - gx, y - gy), k) for k, (n, gx, gy) in enumerate(groups) if math.hypot(x - gx, y - gy) <= max(6, 1.5 * math.hypot(5, 5))]
        if near:
            k = min(near)[1]
            n, gx, gy = groups[k]
            groups[k] = (n + 1, (gx * n + x) / (n + 1), (gy * n + y) / (n + 1))
        else:
            k = len(groups)
            groups.append((1, x, y))
        want[i] = k
    assert {r["event_id"]: r["station"] for r in domain_queries.station_groups(spark, str(tmp_path)).collect()} == want


def test_homography_is_recovered(spark):
    h = np.array([[1.2, 0.1, 5], [0.05, 0.9, -3], [0.0004, 0.0002, 1]])
    rows = []
    for x, y in ((0, 0), (1000, 0), (1000, 700), (0, 700), (500, 300)):
        u, v, w = h @ (x, y, 1)
        rows.append((1, float(x), float(y), float(u / w), float(v / w)))
    r = grouped.homographies(spark.createDataFrame(rows, "kf int, ix double, iy double, px double, py double"), ["kf"]).first()
    assert np.allclose(np.array(r["h"]).reshape(3, 3), h, atol=1e-6) and r["error"] < 1e-6
    k = [F.lit(float(x)) for x in h.ravel()]
    x, y, _ = geometry.projected(k, F.lit(500.0), F.lit(300.0))
    got = spark.range(1).select(x, y).first()
    assert got[0] == pytest.approx(rows[4][3]) and got[1] == pytest.approx(rows[4][4])
    inverse = geometry.adjugate(k)
    eye = spark.range(1).select(*[(c / geometry.determinant(k)).alias(f"c{i}") for i, c in enumerate(geometry.product(k, inverse))]).first()
    assert np.allclose(np.array(list(eye)).reshape(3, 3), np.eye(3), atol=1e-9)


def test_parsing(spark):
    lat, lon = parsing.iso6709(F.col("v"))
    rows = [("+52.0907+005.1214/",), ("+95.0+005.0/",), ("nothing",)]
    assert [tuple(r) for r in spark.createDataFrame(rows, "v string").select(lat.alias("a"), lon.alias("b")).collect()] == [(52.0907, 5.1214), (None, None), (None, None)]
    times = ["2024-05-01T12:00:00Z", "2024-05-01T14:00:00+0200", "2024-05-01 14:00:00+02:00", "2024-05-01T12:00:00", "soon"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in times], "v string").select(parsing.epoch_seconds(F.col("v"))).collect()]
    assert got == [1714564800.0] * 4 + [None]
    r = spark.range(1).select(parsing.leading_number(F.lit(" 12b")), parsing.leading_number(F.lit("x")), parsing.safe_name(F.lit("a b/c")), parsing.clock(F.lit(75.4))).first()
    assert tuple(r) == (12, 0, "a_b_c", "1:15")
    white = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(parsing.lab(parsing.rgb(F.lit("#ffffff"))))]).first()
    assert white[0] == pytest.approx(100, abs=0.1) and abs(white[1]) < 0.1 and abs(white[2]) < 0.1


def test_vectors(spark):
    r = spark.range(1).select(vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))), vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).first()
    assert r[0] == pytest.approx(math.sqrt(0.5)) and r[1] == 0


def test_readers_and_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.1), (2, 0, 0.0)], "clip_id bigint, idx int, t double")
    tables.overwrite(df, str(tmp_path), "frames")
    tables.overwrite(spark.createDataFrame([(2, 5, 9.0)], df.schema), str(tmp_path), "frames")
    got = tables.scan(spark, str(tmp_path), "frames")
    assert {(r["clip_id"], r["idx"]) for r in got.collect()} == {(1, 0), (1, 1), (2, 5)}
    assert {r["clip_id"]: r["fps"] for r in tables.frame_rate(got).collect()} == {1: pytest.approx(10), 2: 10}
    tables.export_csv(spark.createDataFrame([("a", 1)], "name string, n int"), f"{tmp_path}/csv")
    text = next((tmp_path / "csv").glob("*.csv")).read_text(encoding="utf-8")
    assert text.startswith("﻿name;n")


def test_streaming_counts_equal_batch_counts(spark, tmp_path):
    src = spark.range(200).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 3).alias("k"))
    src.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    q = windows.counted(stream, "ts", ["k"], "30 minutes").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("w").agg(F.sum("n")).first()[0] == 200
    done = windows.appended(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    done.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 200


def test_time_joins_have_no_cross_product(spark):
    e = spark.createDataFrame([(1, 10, 5), (1, 20, 6), (2, 10, 7)], "k int, t long, v int")
    for df in (timejoins.as_of(e, e, ["k"], "t", "v"), timejoins.interval_semi(e, e, ["k"], (F.col("t") - 1, F.col("t") + 1), "t")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan and df.count() == 3
