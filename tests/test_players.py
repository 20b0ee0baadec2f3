"""The player tracker against a plain one, and its stream against the batch under random cuts."""

import math
import random

import numpy as np
import pytest

from trackmill.streaming import players

KIND = "clip_id long, idx int, det int, x1 double, y1 double, x2 double, y2 double, conf double, lab array<double>, motion array<double>"


def plain(frames, most_lost):
    """frames: lists of (box, conf, lab) and a motion. One track after the other, one pair after the other."""
    tracks, fresh, out = [], 1, []
    for idx, (boxes, motion) in enumerate(frames):
        if motion is not None:
            for t in tracks:
                x1, y1, x2, y2 = t["box"]
                foot, head = motion @ [(x1 + x2) / 2, y2, 1], motion @ [(x1 + x2) / 2, y1, 1]
                foot, head = foot[:2] / foot[2], head[:2] / head[2]
                w = (x2 - x1) * max(1, foot[1] - head[1]) / max(1, y2 - y1)
                t["box"] = np.array([foot[0] - w / 2, head[1], foot[0] + w / 2, foot[1]])
        for t in tracks:
            t["seen"], t["ahead"] = False, t["box"] + t["v"]

        def score(t, b):
            p, q, lab = t["ahead"], b[0], b[2]
            both = max(0, min(p[2], q[2]) - max(p[0], q[0])) * max(0, min(p[3], q[3]) - max(p[1], q[1]))
            iou = both / ((p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - both + 1e-9)
            h = max(1, p[3] - p[1])
            d = math.hypot((p[0] + p[2] - q[0] - q[2]) / 2, p[3] - q[3])
            s = max(iou, math.exp(-0.5 * (d / (0.35 * h * (1 + 0.5 * min(t["lost"], 10)))) ** 2))
            s *= math.exp(-0.5 * (math.log(max(1, q[3] - q[1]) / h) / 0.25) ** 2)
            if t["lab"] is not None and lab is not None:
                de = math.sqrt(0.25 * (t["lab"][0] - lab[0]) ** 2 + (t["lab"][1] - lab[1]) ** 2 + (t["lab"][2] - lab[2]) ** 2)
                s *= 0.1 + 0.9 * math.exp(-0.5 * (de / 12) ** 2)
            return s

        used = set()
        for lo, hi, least in ((0.4, 9, 0.2), (0.15, 0.4, 0.3)):
            pairs = [(-score(t, b), i, j) for i, t in enumerate(tracks) if not t["seen"] for j, b in enumerate(boxes) if lo <= b[1] < hi]
            for s, i, j in sorted(pairs):
                t = tracks[i]
                if -s < least or t["seen"] or j in used:
                    continue
                used.add(j)
                b = boxes[j]
                t["v"] = 0.6 * t["v"] + 0.4 * (np.array(b[0]) - t["box"]) / (t["lost"] + 1)
                t.update(box=np.array(b[0]), seen=True, hits=t["hits"] + 1)
                t["lost"] = 0
                if b[2] is not None:
                    t["lab"] = np.array(b[2]) if t["lab"] is None else 0.85 * t["lab"] + 0.15 * np.array(b[2])
                if t["hits"] >= 3:
                    out.append((idx, j, t["id"]))
        for t in tracks:
            if not t["seen"]:
                t["lost"] += 1
                t["box"] = t["ahead"]
                t["v"] = t["v"] / 2
        tracks = [t for t in tracks if t["lost"] <= most_lost and not (t["lost"] > 0 and t["hits"] < 3)]
        for j, b in enumerate(boxes):
            if b[1] >= 0.4 and j not in used:
                tracks.append({"id": fresh, "box": np.array(b[0]), "v": np.zeros(4), "hits": 1, "lost": 0, "lab": None if b[2] is None else np.array(b[2])})
                fresh += 1
    return sorted(out)


def scene(rng, n=60):
    """Players that cross, come, go and are missed for some frames, seen by a camera that turns."""
    walkers = [(rng.uniform(100, 1500), rng.uniform(300, 900), rng.uniform(-9, 9), rng.uniform(-3, 3), rng.uniform(40, 120), rng.choice([None, (50.0, 60.0, 20.0), (60.0, -10.0, -40.0)]), rng.randint(0, n // 2)) for _ in range(rng.randint(2, 9))]
    frames, pan = [], 0.0
    for k in range(n):
        turn = rng.choice([0.0, 0.0, rng.uniform(-12, 12)])
        pan += turn
        motion = np.array([[1.0, 0, turn], [0, 1, 0], [0, 0, 1]]) if turn else rng.choice([None, np.eye(3)])
        boxes = []
        for x, y, vx, vy, h, lab, first in walkers:
            if k >= first and rng.random() > 0.15:
                cx, foot = x + vx * (k - first) + pan + rng.gauss(0, 2), y + vy * (k - first) + rng.gauss(0, 2)
                boxes.append(([cx - h / 5, foot - h, cx + h / 5, foot], rng.choice([0.9, 0.7, 0.45, 0.3, 0.1]), None if lab is None or rng.random() < 0.3 else [v + rng.gauss(0, 4) for v in lab]))
        frames.append((boxes if rng.random() > 0.05 else [], motion))
    return frames


def rows_of(clip, frames):
    out = []
    for idx, (boxes, motion) in enumerate(frames):
        m = None if motion is None else motion.ravel().tolist()
        out += [(clip, idx, j, *map(float, b), c, lab, m) for j, (b, c, lab) in enumerate(boxes)] or [(clip, idx, 0, *[None] * 6, m)]
    return out


@pytest.fixture(scope="module")
def scenes():
    rng = random.Random(5)
    return {c: scene(rng) for c in range(1, 7)}


def test_tracks_equal_the_plain_tracker(spark, scenes):
    df = spark.createDataFrame([r for c, f in scenes.items() for r in rows_of(c, f)], KIND).repartition(5)
    got = players.player_tracks(df, 10.0).collect()
    for c, f in scenes.items():
        assert sorted((r["idx"], r["det"], r["track_id"]) for r in got if r["clip_id"] == c) == plain(f, 20)
    assert len(got) > 300
    assert players.player_tracks(df.limit(0), 10.0).count() == 0


def test_short_memory(spark, scenes):
    df = spark.createDataFrame(rows_of(1, scenes[1]), KIND)
    assert sorted((r["idx"], r["det"], r["track_id"]) for r in players.player_tracks(df, 1.0).collect()) == plain(scenes[1], 2)


def test_the_stream_equals_the_batch_however_it_is_cut(spark, scenes, tmp_path):
    rng = random.Random(6)
    rows = {c: rows_of(c, f) for c, f in list(scenes.items())[:3]}
    cuts = {c: sorted(rng.sample(range(1, 60), 3)) for c in rows}
    for k in range(4):
        part = [r for c, rs in rows.items() for r in rs if ([0, *cuts[c]][k]) <= r[1] < ([*cuts[c], 10**6][k])]
        rng.shuffle(part)
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        boxes = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = players.player_stream(boxes, 10.0).writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out", format="parquet")
        assert q.awaitTermination(240)
    finally:
        spark.conf.set(name, before)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    for c in rows:
        assert sorted((r["idx"], r["det"], r["track_id"]) for r in got if r["clip_id"] == c) == plain(scenes[c], 20)
