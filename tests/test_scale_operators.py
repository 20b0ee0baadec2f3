"""Joins by distance, running matrix products, mergeable track states and tables published together, each against a plain version."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmill.operators import accumulate, scans, spatial
from trackmill.sources import published


def metres(a, b):
    east = math.radians((b[1] - a[1] + 180) % 360 - 180) * 6_371_000.0 * math.cos(math.radians((a[0] + b[0]) / 2))
    return math.hypot(east, math.radians(b[0] - a[0]) * 6_371_000.0)


def places(rng, n, centres):
    out = []
    for k in range(n):
        lat, lon = rng.choice(centres)
        lat, lon = lat + rng.gauss(0, 0.0015), lon + rng.gauss(0, 0.003)
        out.append((k, max(-90.0, min(90.0, lat)), (lon + 180) % 360 - 180))
    return out


@pytest.mark.parametrize("reach", [8.0, 30.0, 150.0, 40_000.0])
def test_places_within_reach(spark, reach):
    rng = random.Random(int(reach))
    centres = [(0.0, 0.0), (52.1, 5.1), (60.0, 179.9995), (-71.3, -180.0), (89.9995, 40.0), (-0.0005, 120.0)]
    left, right = places(rng, 260, centres), places(rng, 240, centres)
    a = spark.createDataFrame([*left, (900, None, 1.0), (901, 52.1, None)], "id int, lat double, lon double").repartition(3)
    b = spark.createDataFrame([*right, (900, None, None)], "other int, lat double, lon double")
    want = {(i, j): metres((x, y), (u, v)) for i, x, y in left for j, u, v in right}
    want = {k: d for k, d in want.items() if d <= reach}
    got = spatial.within(a, b, reach, "id", "other").collect()
    assert len(got) == len({(r["id"], r["other"]) for r in got})
    assert {(r["id"], r["other"]) for r in got} == want.keys()
    for r in got:
        assert r["metres"] == pytest.approx(want[r["id"], r["other"]], abs=1e-6)
    best = {r["id"]: r["other"] for r in spatial.nearest_within(a, b, reach, "id", "other").collect()}
    near = {i: min((d, j) for (k, j), d in want.items() if k == i)[1] for i in {k for k, _ in want}}
    assert best == near
    assert spatial.within(a, b.limit(0), reach, "id", "other").count() == 0


def test_a_hot_cell_is_split(spark):
    df = spark.range(5000).select(F.col("id").cast("int").alias("id"), F.lit(52.0).alias("lat"), (F.lit(5.0) + F.col("id") * 1e-9).alias("lon"))
    pairs = spatial.within(df, df.limit(3).withColumnRenamed("id", "other"), 8.0, "id", "other")
    assert pairs.count() == 15_000
    assert spatial.within(df.limit(4), df.limit(4), 8.0, "id", "id").columns == ["id", "id_near", "metres"]


def test_equally_far_places_take_the_smallest_id(spark):
    grid = [(52.0 + i / 1e5, 5.0 + j / 1e5) for i in range(0, 40, 3) for j in range(0, 40, 3)]
    left = spark.createDataFrame([(k, *p) for k, p in enumerate(grid)], "id int, lat double, lon double")
    for a, b in ((2e-5, 0.0), (0.0, 2e-5)):  # one on either side of each, further ones beyond; the later side has the smaller ids
        sides = [(2 * k + (s < 0), lat + s * a, lon + s * b) for k, (lat, lon) in enumerate(grid) for s in (1, -1)]
        known = spark.createDataFrame(sides, "other int, lat double, lon double")
        want = {}
        for k, p in enumerate(grid):
            want[k] = min((round(metres(p, (lat, lon)), 6), o) for o, lat, lon in sides)[1]
        assert {r["id"]: r["other"] for r in spatial.nearest_within(left, known, 150.0, "id", "other", digits=6).collect()} == want


def test_the_nearest_of_a_dense_place_is_found_without_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    spots = [(52.0 + rng.randrange(300) / 1e5, 5.0 + rng.randrange(300) / 1e5) for _ in range(1500)]
    left = [(k, *rng.choice(spots)) for k in range(1500)] + [(9001, 52.0, 5.0045), (9002, 52.0, 5.01), (9003, 52.0, 5.0045), (9003, None, 5.0)]
    right = [(k, *rng.choice(spots)) for k in range(1500)] + [(k, 52.001, 5.001) for k in range(2000, 4000)]
    met, plain = [], spatial.within
    monkeypatch.setattr(spatial, "within", lambda *a: met.append(plain(*a)) or met[-1])
    a, b = (spark.createDataFrame(r, f"{n} int, lat double, lon double").repartition(3) for r, n in ((left, "id"), (right, "other")))
    got = {r["id"]: r["other"] for r in spatial.nearest_within(a, b, 150.0, "id", "other", digits=6).collect()}
    distinct = {}
    for k, *p in right:
        distinct[tuple(p)] = min(k, distinct.get(tuple(p), k))
    want = {}
    for k, lat, lon in left:
        d, j = min(((round(metres((lat, lon), p), 6), j) for p, j in distinct.items()), default=(math.inf, 0)) if lat else (math.inf, 0)
        if d <= 150:
            want[k] = j
    assert got == want and 9001 in got and 9002 not in got
    assert len(met) > 1 and sum(p.count() for p in met) < 60_000  # of 5 million within reach


@pytest.mark.parametrize("block", [1, 7, 64, 10_000])
def test_running_products(spark, block):
    rng = np.random.default_rng(block)
    rows, want = [], {}
    for clip, n in ((1, 200), (2, 1), (3, 65), (None, 9)):
        total = np.eye(3)
        for k in range(n):
            h = np.eye(3) + rng.normal(0, [[0.01, 0.01, 3], [0.01, 0.01, 3], [1e-6, 1e-6, 0.05]])
            m = None if k % 9 == 4 else h
            total = (np.eye(3) if m is None else m) @ total
            total = total / total[2, 2]
            rows.append((clip, k * 3, None if m is None else m.ravel().tolist(), "x"))
            want[clip, k * 3] = total.ravel()
    df = spark.createDataFrame(rows, "clip_id int, idx int, h array<double>, note string").repartition(4)
    got = scans.prefix_products(df, ["clip_id"], "idx", "h", block).collect()
    assert len(got) == len(rows)
    for r in got:
        assert np.allclose(r["product"], want[r["clip_id"], r["idx"]], rtol=1e-6, atol=1e-6)


ROWS = "clip_id int, track_id int, idx int, t double, x1 double, y1 double, x2 double, y2 double, x double, y double, lab array<double>"


def track_rows(rng):
    out = []
    for track in range(1, 9):
        for k in sorted(rng.sample(range(3000), rng.choice([1, 4, 12, 400]))):
            h = rng.randint(20, 200)
            out.append((1, track, k, k / 10, 5.0, 10.0, 9.0, 10.0 + h, *((None, None) if rng.random() < 0.3 else (rng.random(), rng.random())), None if rng.random() < 0.4 else [rng.uniform(0, 90) for _ in range(3)]))
    return out


def summary(r):
    return {k: (tuple(v) if hasattr(v, "_fields") or isinstance(v, tuple) else v) for k, v in r.asDict(True).items()}


def test_track_states_merge_in_any_way(spark):
    rng = random.Random(3)
    rows = track_rows(rng)
    df = spark.createDataFrame(rows, ROWS)
    whole = {r["track_id"]: summary(r) for r in accumulate.finished(accumulate.merged(accumulate.part_states(df))).collect()}
    for track in range(1, 9):
        own = [r for r in rows if r[1] == track]
        got, placed = whole[track], [r for r in own if r[8] is not None]
        assert got["n"] == len(own)
        assert (got["first"]["idx"], got["last"]["idx"], got["first"]["t"]) == (own[0][2], own[-1][2], own[0][3])
        assert (got["first"]["fx"], got["last"]["fy"]) == (7.0, own[-1][7])
        assert got["h0"] == statistics.median(r[7] - r[5] for r in own[:5]) and got["h1"] == statistics.median(r[7] - r[5] for r in own[-5:])
        assert got["p0"] == ({"x": placed[0][8], "y": placed[0][9]} if placed else None)
        assert got["p1"] == ({"x": placed[-1][8], "y": placed[-1][9]} if placed else None)
        assert [b["idx"] for b in got["tallest"]] == [r[2] for r in sorted(own, key=lambda r: (r[5] - r[7], r[2]))[:6]]
        labs = [r[10] for r in own if r[10]]
        if len(labs) <= accumulate.COLOURS:
            assert (got["lab"] is None) == (not labs)
            if labs:
                assert got["lab"] == pytest.approx([statistics.median(x) for x in zip(*labs, strict=True)])
    for seed in range(2):  # parts in any order, merged in two rounds
        rng = random.Random(seed)
        mixed = rows[:]
        rng.shuffle(mixed)
        parts = [accumulate.part_states(spark.createDataFrame(mixed[k::3], ROWS), frames=rng.choice([1, 50, 9999])) for k in range(3)]
        two = accumulate.merged(parts[0].union(parts[2]))
        again = {r["track_id"]: summary(r) for r in accumulate.finished(accumulate.merged(two.union(parts[1]))).collect()}
        assert again == whole


def test_states_of_stitched_tracks_merge(spark):
    rng = random.Random(4)
    df = spark.createDataFrame(track_rows(rng), ROWS)
    root = (F.col("track_id") % 2).cast("int")
    by_root = accumulate.finished(accumulate.merged(accumulate.merged(accumulate.part_states(df)).withColumn("root", root), ["clip_id", "root"]))
    assert {r["root"]: r["n"] for r in by_root.collect()} == {r["root"]: r["n"] for r in df.groupBy(root.alias("root")).agg(F.count("*").alias("n")).collect()}


def test_states_of_a_stream_equal_the_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = track_rows(rng)
    rng.shuffle(rows)
    cuts = sorted(rng.sample(range(len(rows)), 3))
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        spark.createDataFrame(rows[a:b], ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    root = f"file://{tmp_path}/states"
    kind = accumulate.part_states(spark.createDataFrame([], ROWS)).schema

    def add(batch, n):
        old = published.read(spark, root, "states", kind)
        published.publish(spark, root, {"states": accumulate.merged(old.union(accumulate.part_states(batch)))})

    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(240)
    got = accumulate.finished(published.read(spark, root, "states", kind))
    want = accumulate.finished(accumulate.merged(accumulate.part_states(spark.createDataFrame(rows, ROWS))))
    assert {r["track_id"]: summary(r) for r in got.collect()} == {r["track_id"]: summary(r) for r in want.collect()}


def test_tables_are_published_together(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    boxes, tracks = "clip_id int, idx int", "clip_id int, name string"
    df = lambda rows, kind: spark.createDataFrame(rows, kind)
    rows = lambda name, kind, **k: sorted((tuple(r) for r in published.read(spark, root, name, kind, **k).collect()), key=str)
    assert rows("boxes", boxes) == []
    assert published.publish(spark, root, {"boxes": df([(1, 1), (1, 2), (2, 1), (None, 7)], boxes), "tracks": df([(1, "a"), (2, "b")], tracks)}) == 1
    assert rows("boxes", boxes) == [(1, 1), (1, 2), (2, 1), (None, 7)]
    # Clip 1 is analysed again: fewer boxes, no track; clip 2 stays.
    assert published.publish(spark, root, {"boxes": df([(1, 9)], boxes), "tracks": df([], tracks)}, replaced=[1]) == 2
    assert rows("boxes", boxes) == [(1, 9), (2, 1), (None, 7)] and rows("tracks", tracks) == [(2, "b")]
    assert rows("boxes", boxes, only=[1, None]) == [(1, 9), (None, 7)] and rows("boxes", boxes, version=1) == [(1, 1), (1, 2), (2, 1), (None, 7)]
    # A write that fails on the way leaves both tables as they were.
    bad = df([(2, 5)], boxes).withColumn("idx", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        published.publish(spark, root, {"tracks": df([(2, "new")], tracks), "boxes": bad})
    assert rows("boxes", boxes) == [(1, 9), (2, 1), (None, 7)] and rows("tracks", tracks) == [(2, "b")]
    # A table can be rewritten from itself.
    again = published.read(spark, root, "boxes", boxes).withColumn("idx", F.col("idx") + 1)
    assert published.publish(spark, root, {"boxes": again}) == 3
    assert rows("boxes", boxes) == [(1, 10), (2, 2), (None, 8)]
    with pytest.raises(Exception, match="already exists"):  # a second writer of a version
        published.manifest(spark, root).write.mode("error").parquet(f"{root}/manifests/{3:012d}")
