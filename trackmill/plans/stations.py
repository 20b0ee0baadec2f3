"""Clips filmed from one place: carrying calibrations from clip to clip, in rounds, and how far each can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackmill.functions import camera, geometry
from trackmill.operators import calibration
from trackmill.operators.rounds import fix_point, shortest_paths

#: Degrees turned from a keyframe from which a calibration is unsure; shared points of a match; degrees that a relay must save (fixed values).
TRUST, INLIERS, GAIN = 45.0, 30, 10.0


def matrix(c: str | Column) -> list[Column]:
    at = F.col(c) if isinstance(c, str) else c
    return [at[i] for i in range(9)]


def signed(m: list[Column]) -> Column:
    """A matrix scaled to a last element of size one, its sign kept."""
    size = F.abs(m[8])
    return F.array(*[v / F.when(size > 1e-12, size).otherwise(1.0) for v in m])


def carried(first: Column, then: Column) -> Column:
    return signed(geometry.product(matrix(first), matrix(then)))


def facing(h: Column, width: Column, height: Column) -> Column:
    """The direction in degrees on the pitch in which the lower middle of the image looks; null where that is not before the camera."""
    low = geometry.projected(matrix(h), width / 2, 0.98 * height)
    up = geometry.projected(matrix(h), width / 2, 0.85 * height)
    dx, dy = up[0] - low[0], up[1] - low[1]
    return F.when(F.hypot(dx, dy) > 1e-6, F.degrees(F.atan2(dy, dx)))


def turned(a: Column, b: Column) -> Column:
    """Degrees between two directions; 0 where one is unknown."""
    return F.coalesce(F.abs(geometry.wrapped(a - b)), F.lit(0.0))


def panorama(calibrated: DataFrame, frames: DataFrame) -> DataFrame:
    """Reference images: the frames of clips that have a calibrated frame (station, clip_id, t, h, turn), carried there by the camera's motion.

    frames: clip_id, t, a (motion to the clip's reference frame), width, height. Each gets the calibrated frame from which it is turned least
    (then the earliest). turn: degrees, with those of the calibrated frame itself.
    """
    base = calibrated.join(frames.select("clip_id", "t", "a", "width", "height"), ["clip_id", "t"])
    # The divisor's sign tells what is before the camera; the inverse, not the adjugate, keeps it.
    back = F.array(*[x * F.signum(geometry.determinant(matrix("a"))) for x in geometry.adjugate(matrix("a"))])
    base = base.select("station", "clip_id", F.col("t").alias("from_t"), "turn", carried(F.col("h"), back).alias("hb"), facing(F.col("h"), F.col("width"), F.col("height")).alias("look"))
    all_ = frames.join(base, "clip_id").withColumn("h", carried(F.col("hb"), F.col("a")))
    all_ = all_.withColumn("turn", F.col("turn") + turned(facing(F.col("h"), F.col("width"), F.col("height")), F.col("look")))
    best = F.min(F.struct("turn", "from_t", "h"))
    return all_.groupBy("station", "clip_id", "t").agg(best.alias("m")).select("station", "clip_id", "t", "m.h", "m.turn")


def relayed(references: DataFrame, matches: DataFrame) -> DataFrame:
    """References (station, clip_id, t, h, turn, width, height) that are far turned, with the calibration of the path over other clips' references that turns least.

    matches: station, clip_id, t, ref_clip, ref_t, m (image to reference image), inliers: pairs of references with enough in common. A path costs the degrees turned at each
    step and the turn where it starts; one that saves ten degrees or more replaces the reference's own. All references are walked at once. [STA-16]
    """
    node = F.struct("clip_id", "t")
    other = F.struct(F.col("ref_clip").alias("clip_id"), F.col("ref_t").alias("t"))
    look = references.select("station", node.alias("n"), facing(F.col("h"), F.col("width"), F.col("height")).alias("look"), F.col("h").alias("own"), "turn")
    good = matches.where((F.col("inliers") >= 2 * INLIERS) & (F.col("clip_id") != F.col("ref_clip"))).select("station", node.alias("dst"), other.alias("src"), "m")
    good = good.join(look.select("station", F.col("n").alias("dst"), F.col("look").alias("to")), ["station", "dst"]).join(look.select("station", F.col("n").alias("src"), F.col("look").alias("from")), ["station", "src"])
    edges = good.select("station", "src", "dst", turned(F.col("to"), F.col("from")).alias("cost"))
    paths = shortest_paths(edges, look.select("station", F.col("n").alias("node"), F.col("turn").alias("cost")), ["station"])
    paths = paths.join(look.select("station", F.col("n").alias("node"), "turn"), ["station", "node"]).where((F.col("turn") > TRUST / 2) & (F.col("cost") < F.col("turn") - GAIN) & (F.size("path") > 1))
    # The steps' matrices, multiplied from the start on: a path is a short array.
    steps = paths.select("station", "node", "cost", F.explode(F.transform(F.slice("path", 2, F.size("path") - 1), lambda n, i: F.struct(i.alias("i"), F.col("path")[i].alias("src"), n.alias("dst")))).alias("s"))
    steps = steps.select("station", "node", "cost", "s.*").join(good.select("station", "src", "dst", "m"), ["station", "src", "dst"])
    steps = steps.groupBy("station", "node").agg(F.first("cost").alias("cost"), F.sort_array(F.collect_list(F.struct("i", "src", "m"))).alias("steps"))
    steps = steps.withColumn("start", F.col("steps")[0]["src"]).join(look.select("station", F.col("n").alias("start"), "own"), ["station", "start"])
    found = steps.select("station", F.col("node.clip_id").alias("clip_id"), F.col("node.t").alias("t"), F.aggregate("steps", F.col("own"), lambda h, s: carried(h, s["m"])).alias("relay_h"), F.col("cost").alias("relay_turn"))
    out = references.join(found, ["station", "clip_id", "t"], "left")
    return out.withColumn("h", F.coalesce("relay_h", "h")).withColumn("turn", F.coalesce("relay_turn", "turn")).drop("relay_h", "relay_turn")


def proposals(matches: DataFrame, references: DataFrame) -> DataFrame:
    """Frames (station, clip_id, t, h, inliers, turn) that look like a reference: of the matches with six tenths of the best one's shared points, the least turned reference."""
    m = matches.join(references.select("station", F.col("clip_id").alias("ref_clip"), F.col("t").alias("ref_t"), F.col("h").alias("rh"), F.col("turn")), ["station", "ref_clip", "ref_t"])
    w = Window.partitionBy("station", "clip_id", "t")
    m = m.where(F.col("inliers") >= INLIERS).withColumn("top", F.max("inliers").over(w)).where(F.col("inliers") >= 0.6 * F.col("top"))
    best = F.min_by(F.struct("inliers", "turn", carried(F.col("rh"), F.col("m")).alias("h")), F.struct("turn", -F.col("inliers"), "ref_clip", "ref_t"))
    return m.groupBy("station", "clip_id", "t").agg(best.alias("b")).select("station", "clip_id", "t", "b.*")


def calibrate(own: DataFrame, frames: DataFrame, matches: DataFrame, cameras: DataFrame) -> DataFrame:
    """Calibrations for clips without one of their own, found through images of clips that have one, in rounds until none is found. [CAL-06, CAL-07]

    own: station, clip_id, t, h, turn (0) of clips calibrated by hand; frames: clip_id, t, a, width, height; matches: station, clip_id, t, ref_clip, ref_t,
    m, inliers; cameras: station, station_camera (of its anchor). A clip takes its frame with most shared points (then the earliest) that fits a
    camera at the station's place, and joins the references of the next round with all its frames. Returns the rows of `own` and those found, with
    `round` (0: own) and `method` (hand or surroundings).
    """
    first = own.select("station", "clip_id", "t", "h", F.col("turn").cast("double").alias("turn"), F.lit(0).alias("round"), F.lit("hand").alias("method"))
    sized = frames.groupBy("clip_id").agg(F.first("width").alias("width"), F.first("height").alias("height"))

    def step(added: DataFrame, found: DataFrame) -> DataFrame:
        # Only clips that share an image with a newly calibrated clip can change; they look at all references of their station.
        near = matches.join(added.select("station", F.col("clip_id").alias("ref_clip")).distinct(), ["station", "ref_clip"], "left_semi").select("station", "clip_id").distinct()
        todo = near.join(found.select("station", "clip_id").distinct(), ["station", "clip_id"], "left_anti")
        asked = matches.join(todo, ["station", "clip_id"], "left_semi")
        got = proposals(asked, panorama(found, frames)).join(sized, "clip_id").join(cameras, "station")
        got = calibration.plausible(got).where("view.ok")
        best = F.max_by(F.struct("t", "h", "turn"), F.struct("inliers", -F.col("t")))
        number = added.agg(F.max("round")).first()[0] + 1
        return got.groupBy("station", "clip_id").agg(best.alias("b")).select("station", "clip_id", "b.t", "b.h", "b.turn", F.lit(number).alias("round"), F.lit("surroundings").alias("method"))

    return fix_point(first, step, ["station", "clip_id"])


def coverage(clips: DataFrame, keyframes: DataFrame, near_s: float = 5.0, points: int = 200) -> DataFrame:
    """(clip_id, coverage): the share of 200 even moments of a clip within 5 s of a keyframe; 1 where length or keyframes are unknown."""
    times = keyframes.groupBy("clip_id").agg(F.collect_list("t").alias("ts"))  # a clip has a few
    c = clips.select(F.col("id").alias("clip_id"), "duration").join(times, "clip_id", "left")
    at = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i * F.col("duration") / (points - 1))
    hit = F.size(F.filter(at, lambda t: F.exists("ts", lambda k: F.abs(t - k) <= near_s)))
    return c.select("clip_id", F.when((F.col("duration") > 0) & F.col("ts").isNotNull(), hit / points).otherwise(1.0).alias("coverage"))


def overview(clips: DataFrame, keyframes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Clips with their station, state, how far they are turned from a keyframe, trust in percent, and their station's anchor. [QRY-10]

    clips: id, station, status, review, duration; keyframes: clip_id, t, auto, source (`station` for proposals), bad (its clicks don't fit), method, lines, unsure,
    turn; anchors: station, clip_id, x, y, height.
    """
    proposed = F.col("source") == "station"
    mine = ~F.col("auto") & ~F.coalesce(proposed, F.lit(False))
    best = F.max_by(F.struct("method", "lines", "unsure"), F.when(proposed, F.struct(F.coalesce("lines", F.lit(False)), -F.coalesce("turn", F.lit(0.0)), -F.col("t"))))
    k = keyframes.groupBy("clip_id").agg(
        F.count_if(mine).alias("own"), F.count_if(mine & F.col("bad")).alias("own_bad"), F.count_if(proposed).alias("proposals"), best.alias("best"),
        F.max(F.when(proposed, F.col("turn"))).alias("turn"),
    )
    c = clips.withColumn("clip_id", F.col("id")).join(k, "clip_id", "left").na.fill(0, ["own", "own_bad", "proposals"]).join(coverage(clips, keyframes), "clip_id", "left")
    state = (
        F.when(F.col("own") > 0, "own").when((F.col("proposals") > 0) | F.col("review").isin("failed", "rejected"), F.col("review"))
        .when(F.coalesce(F.col("status") != "done", F.lit(True)), "not analysed").otherwise("open")
    )
    turn = F.when(F.col("proposals") > 0, F.coalesce("turn", F.lit(0.0)))
    trust = camera.confidence(F.col("review"), F.col("own"), F.col("own_bad"), F.coalesce("best.lines", F.lit(False)), F.col("best.method"), F.coalesce("best.unsure", F.lit(False)), turn, F.col("coverage"))
    a = anchors.select("station", F.col("clip_id").alias("anchor_clip"), *[F.round(F.col(v), 1).alias(f"anchor_{v}") for v in ("x", "y", "height")])
    return c.join(a, "station", "left").select(
        "station", F.col("id").alias("clip_id"), state.alias("state"), F.coalesce(F.col("turn") > TRUST, F.lit(False)).alias("uncertain"), F.round("turn").cast("int").alias("turn_deg"),
        F.round("coverage", 3).alias("coverage"), trust.alias("confidence"), "anchor_clip", "anchor_x", "anchor_y", "anchor_height",
    )
