"""Which tracks belong to which player: summaries, continuity, recognition, stitching, spectators, teams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.functions import camera, geometry, parsing, vectors
from trackmill.operators import accumulate, choose

KEYS = ["clip_id", "track_id"]


def summaries(rows: DataFrame) -> DataFrame:
    """Per track (rows: clip_id, track_id, idx, t, x1..y2, x, y): first and last time, frame, foot and place, median heights of its first and last five rows. [AGG-12, WIN-18, AGG-31]"""
    lab = rows if "lab" in rows.columns else rows.withColumn("lab", F.lit(None).cast("array<double>"))
    return accumulate.finished(accumulate.merged(accumulate.part_states(lab))).select(*KEYS, "n", "first", "last", "p0", "p1", "h0", "h1")


def tallest(rows: DataFrame, most: int = 6) -> DataFrame:
    """The tallest boxes of each track, for its appearance. [AGG-31]"""
    return choose.top_k(rows.withColumn("h", F.col("y2") - F.col("y1")), KEYS, [F.desc("h"), "idx"], most)


def suggestions(summary: DataFrame, tracks: DataFrame, player: int, team: int, most: int = 8, number: str | None = None, motion: DataFrame | None = None) -> DataFrame:
    """Unlinked tracks that likely belong to a player too, best first. [QRY-06, STA-06, JOI-13, SFN-17, SFN-18, TOP-03]

    tracks: clip_id, track_id, player_id, team, lab (array of three, or null), with teams already overridden; if known, look (likeness to the player's profile),
    jersey_guess and jersey_conf, which count against the player's number. A track seen together with one of the player's for over 0.3 s is out; its fit is the
    best continuity with a track of the player's (0.3 where the clip has none), its rival the best with a team mate's. Places on the pitch decide where both tracks have one; else the feet
    in the image, moved by the camera (motion: clip_id, idx, a to the reference frame; without it the camera stands still).
    """
    known = [c for c in ("look", "jersey_guess", "jersey_conf") if c in tracks.columns]
    s = summary.join(tracks.select(*KEYS, "player_id", "team", "lab", *known), KEYS)
    for c, kind in (("look", "double"), ("jersey_guess", "string"), ("jersey_conf", "double")):
        s = s if c in known else s.withColumn(c, F.lit(None).cast(kind))
    if motion is not None:
        for end in ("first", "last"):
            m = motion.select("clip_id", F.col("idx").alias("__i"), F.col("a").alias(f"a_{end}"))
            s = s.withColumn("__i", F.col(f"{end}.idx")).join(m, ["clip_id", "__i"], "left").drop("__i")
    else:
        s = s.withColumn("a_first", F.lit(None).cast("array<double>")).withColumn("a_last", F.lit(None).cast("array<double>"))
    free = s.where(F.col("player_id").isNull() & F.col("team").isin(team, -1) & (F.col("n") >= 5))
    names = ("first", "last", "p0", "p1", "h0", "h1", "a_first", "a_last")
    linked = s.where("player_id is not null").select("clip_id", F.col("player_id").alias("o"), *[F.col(c).alias(f"o_{c}") for c in names])
    j = free.join(linked, "clip_id")  # a clip's linked tracks are a few dozen

    def goes_on(a: str, b: str) -> tuple[Column, Column, Column]:
        """Continuity, gap and metres of the track with prefix b after that with prefix a."""
        gap = F.col(f"{b}first.t") - F.col(f"{a}last.t")
        metres = F.hypot(F.col(f"{b}p0.x") - F.col(f"{a}p1.x"), F.col(f"{b}p0.y") - F.col(f"{a}p1.y"))
        one = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)])
        m = lambda c: [F.coalesce(F.col(c), one)[i] for i in range(9)]
        rx, ry, _ = geometry.projected(m(f"{a}a_last"), F.col(f"{a}last.fx"), F.col(f"{a}last.fy"))
        qx, qy, _ = geometry.projected(geometry.adjugate(m(f"{b}a_first")), rx, ry)
        tall = F.greatest(F.lit(1.0), 0.5 * (F.col(f"{a}h1") + F.col(f"{b}h0")))
        moved = F.coalesce(F.hypot(qx - F.col(f"{b}first.fx"), qy - F.col(f"{b}first.fy")) / tall, F.lit(float("inf")))
        seen = camera.continuity_seen(gap, moved, F.col(f"{b}h0") / F.greatest(F.lit(1.0), F.col(f"{a}h1")))
        return F.coalesce(camera.continuity(gap, metres), seen), gap, metres

    after, before = goes_on("o_", ""), goes_on("", "o_")
    fit = F.greatest(F.coalesce(after[0], F.lit(0.0)), F.coalesce(before[0], F.lit(0.0)))
    together = F.least(F.col("last.t"), F.col("o_last.t")) - F.greatest(F.col("first.t"), F.col("o_first.t")) > 0.3
    follows = F.coalesce(after[0], F.lit(0.0)) >= F.coalesce(before[0], F.lit(0.0))
    mine = F.col("o") == player
    pick = lambda k: F.when(fit > 0, F.when(follows, after[k]).otherwise(before[k]))
    own = F.when(mine, F.struct(fit.alias("fit"), pick(1).alias("gap"), pick(2).alias("distance"), follows.alias("later")))
    g = j.groupBy(*KEYS).agg(F.max(own).alias("own"), F.max(F.when(~mine, fit)).alias("rival"), F.max((mine & together).cast("int")).alias("together"))
    shirt = s.where((F.col("player_id") == player) & F.col("lab").isNotNull()).agg(*[(F.sum(F.col("lab")[i] * F.col("n")) / F.sum("n")).alias(f"c{i}") for i in range(3)])
    out = free.join(g, KEYS, "left").where(F.coalesce("together", F.lit(0)) == 0).join(F.broadcast(shirt))  # one row
    colour = F.sqrt(0.25 * F.pow(F.col("lab")[0] - F.col("c0"), 2) + F.pow(F.col("lab")[1] - F.col("c1"), 2) + F.pow(F.col("lab")[2] - F.col("c2"), 2))
    fitted, rival = F.coalesce("own.fit", F.lit(0.3)), F.coalesce("rival", F.lit(0.0))
    shown = F.col("jersey_guess").isNotNull() & (F.coalesce("jersey_conf", F.lit(0.0)) >= 0.4)
    same = F.when(shown, F.col("jersey_guess") == number.strip()) if number and number.strip() else F.lit(None).cast("boolean")
    out = out.withColumn("score", F.round(camera.link_score(fitted, rival, colour, F.col("look"), same), 3))
    out = out.withColumn("reason", camera.link_reasons(F.col("own.gap"), F.col("own.distance"), rival, fitted, colour, F.col("look"), F.col("own.later")))
    return out.select(*KEYS, F.round("first.t", 2).alias("t_start"), F.round("last.t", 2).alias("t_end"), "n", "score", "reason").orderBy(F.desc("score"), *KEYS).limit(most)


def recognised(tracks: DataFrame, profiles: DataFrame, seen: DataFrame, least: float = 0.35, margin: float = 0.12) -> DataFrame:
    """The player that each unlinked track looks like: best profile of its team, 0.35 at least and 0.12 ahead of the next; not one who is in view elsewhere
    at the time (seen: clip_id, player_id, t0, t1). [QRY-07, STA-05, JOI-20, SFN-16, TOP-04]"""
    # A track without a team meets the profiles of all: each stands under its team and under none.
    p = profiles.select(F.col("player_id").alias("p"), F.explode(F.array_distinct(F.array(F.col("team"), F.lit(-1).cast(profiles.schema["team"].dataType)))).alias("team"), F.col("emb").alias("pemb"))
    j = tracks.join(p, "team")
    j = j.withColumn("score", vectors.cosine(F.col("emb"), F.col("pemb")))
    away = seen.select(F.col("clip_id").alias("c"), F.col("player_id").alias("q"), F.col("t0").alias("s0"), F.col("t1").alias("s1"))
    clash = (F.col("clip_id") == F.col("c")) & (F.col("p") == F.col("q")) & (F.least("t1", "s1") - F.greatest("t0", "s0") > 0.3)
    return choose.top_with_margin(j.join(away, clash, "left_anti"), KEYS, "score", "p", least, margin).select(*KEYS, F.col("p").alias("player_id"), "score")


def auto_assigned(tracks: DataFrame, players: DataFrame, least: float = 0.5) -> DataFrame:
    """Unlinked tracks with the player of their team whose shirt number they show; of players with one number the last. [STA-09, JOI-15]"""
    p = choose.latest(players.where("number is not null").withColumn("number", F.trim("number")), ["number", "team"], ["id"])
    t = tracks.where(F.col("player_id").isNull() & F.col("jersey_guess").isNotNull() & (F.col("jersey_conf") >= least)).drop("player_id")
    return t.join(p.select(F.col("number").alias("jersey_guess"), "team", F.col("id").alias("player_id")), ["jersey_guess", "team"])


def stitch_candidates(summary: DataFrame, fps: float, max_gap_s: float = 3.0) -> DataFrame:
    """Pairs of tracks of a clip of which the second may go on with the first, with a cost: a gap of at most 3 s, like size and shirt, near the place
    that the first was heading for. [JOI-19]

    summary: clip_id, track_id, s, e (first and last frame), p0, p1 (structs x, y in the image), v (struct, per frame), h0, h1, lab (or null).
    """
    a = summary.select("clip_id", *[F.col(c).alias(f"a_{c}") for c in ("track_id", "e", "p1", "v", "h1", "lab")])
    reach = max(1, round(max_gap_s * fps))
    a = a.withColumn("bucket", F.explode(F.array(F.floor(F.col("a_e") / reach), F.floor(F.col("a_e") / reach) + 1)))
    b = summary.select("clip_id", *[F.col(c).alias(f"b_{c}") for c in ("track_id", "s", "p0", "h0", "lab")], F.floor(F.col("s") / reach).alias("bucket"))
    j = a.join(b, ["clip_id", "bucket"]).withColumn("gap", F.col("b_s") - F.col("a_e")).where((F.col("gap") > 0) & (F.col("gap") <= reach) & (F.col("a_track_id") != F.col("b_track_id")))
    ratio = F.col("b_h0") / F.greatest(F.lit(1.0), F.col("a_h1"))
    lab = lambda i: F.col("a_lab")[i] - F.col("b_lab")[i]
    de = F.coalesce(F.sqrt(F.pow(0.5 * lab(0), 2) + F.pow(lab(1), 2) + F.pow(lab(2), 2)), F.lit(0.0))
    ahead = F.least(F.col("gap"), F.lit(fps))
    dist = F.hypot(F.col("b_p0.x") - F.col("a_p1.x") - F.col("a_v.x") * ahead, F.col("b_p0.y") - F.col("a_p1.y") - F.col("a_v.y") * ahead)
    gate = 0.5 * (F.col("a_h1") + F.col("b_h0")) * (1.0 + 0.35 * F.col("gap") * 10 / fps)
    return j.where((ratio > 0.67) & (ratio < 1.5) & (de <= 15) & (dist <= gate)).select("clip_id", F.col("a_track_id").alias("a"), F.col("b_track_id").alias("b"), (dist / gate + 0.5 * de / 18 + 0.02 * F.col("gap")).alias("cost"))


def relabelled(rows: DataFrame, roots: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows with the chain root's id for their track's, without dropped rows (clip_id, idx). [STR-10]"""
    r = roots.select("clip_id", F.col("track").alias("track_id"), "root")
    return rows.join(r, KEYS, "left").withColumn("track_id", F.coalesce("root", "track_id")).drop("root").join(dropped.select("clip_id", "idx"), ["clip_id", "idx"], "left_anti")


def anchored_feet(rows: DataFrame, motion: DataFrame) -> DataFrame:
    """Rows (clip_id, idx, x1, y1, x2, y2, ...) with `ax`, `ay`: the foot's place in the clip's reference frame, the camera's motion (clip_id, idx, a) taken out; null without it. [QRY-16]"""
    j = rows.join(motion.select("clip_id", "idx", "a"), ["clip_id", "idx"], "left")
    fx, fy = geometry.foot(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    ax, ay, _ = geometry.projected([F.col("a")[i] for i in range(9)], fx, fy)
    return j.withColumn("ax", ax).withColumn("ay", ay).drop("a")


def like_spectators(tracks: DataFrame, chosen: DataFrame, colour: float = 14.0, bodies: float = 1.5, metres: float = 4.0, most: int = 40) -> DataFrame:
    """Tracks of a match like ones marked as spectators, or just beside them: shirt within 14, still 40 % of the time, and at their place, best first. [QRY-13, STA-08]

    Both: clip_id, track_id, lab, ax, ay (median foot in the reference frame, null: unknown), x, y (median place on the pitch, null: not calibrated); chosen with its median
    height h; tracks with still, valid (they count in statistics), and if known linked (to a player). Within a clip places are the reference frame's, at most one and a half body
    heights apart; where that isn't known, and in other clips, they are the pitch's, at most 4 m apart. Each space is cut into cells as large as its reach, so only tracks near a marked one meet it.
    """
    t = tracks.where(F.col("valid") & (F.col("still") >= 0.4) & F.col("lab").isNotNull())
    t = t.where("not coalesce(linked, false)") if "linked" in t.columns else t
    t = t.select(*KEYS, "still", *[F.col(c).alias(f"t_{c}") for c in ("lab", "ax", "ay", "x", "y")])
    c = chosen.where("lab is not null").select(F.col("clip_id").alias("c_clip"), F.col("track_id").alias("c_track"), F.greatest(F.lit(1.0), "h").alias("h"), *[F.col(x).alias(f"c_{x}") for x in ("lab", "ax", "ay", "x", "y")])
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    cells = lambda v, size: F.transform(around, lambda k: F.floor(v / size) + k)
    lab = lambda i: F.col("t_lab")[i] - F.col("c_lab")[i]
    shade = F.sqrt(F.pow(0.5 * lab(0), 2) + F.pow(lab(1), 2) + F.pow(lab(2), 2))
    # The reference frame's cells have a size for each marked track: its reach. Sizes are rounded up to powers of two, so tracks need few.
    size = F.pow(2.0, F.ceil(F.log2(bodies * F.col("h"))))
    marked = c.where("c_ax is not null").withColumn("size", size).withColumn("u", F.explode(cells(F.col("c_ax"), size))).withColumn("v", F.explode(cells(F.col("c_ay"), size)))
    sizes = marked.select(F.col("c_clip").alias("clip_id"), "size").distinct()
    inside = t.where("t_ax is not null").join(sizes, "clip_id").withColumn("u", F.floor(F.col("t_ax") / F.col("size"))).withColumn("v", F.floor(F.col("t_ay") / F.col("size")))
    inside = inside.join(marked.withColumn("clip_id", F.col("c_clip")), ["clip_id", "size", "u", "v"]).withColumn("d", F.hypot(F.col("t_ax") - F.col("c_ax"), F.col("t_ay") - F.col("c_ay")) / F.col("h")).where(F.col("d") <= bodies)
    placed = c.where("c_x is not null").withColumn("u", F.explode(cells(F.col("c_x"), metres))).withColumn("v", F.explode(cells(F.col("c_y"), metres)))
    near = t.where("t_x is not null").withColumn("u", F.floor(F.col("t_x") / metres)).withColumn("v", F.floor(F.col("t_y") / metres)).join(placed, ["u", "v"])
    near = near.withColumn("d", F.hypot(F.col("t_x") - F.col("c_x"), F.col("t_y") - F.col("c_y")) / metres).where(F.col("d") <= 1)
    near = near.where((F.col("clip_id") != F.col("c_clip")) | F.col("t_ax").isNull() | F.col("c_ax").isNull())
    here = F.lit("same place in the image")
    there = F.format_string("%.0f m from the marked place", F.col("d") * metres)
    both = inside.withColumn("reason", here).select(*KEYS, "still", "t_lab", "c_lab", "d", "reason").union(near.withColumn("reason", there).select(*KEYS, "still", "t_lab", "c_lab", "d", "reason"))
    found = both.where(shade <= colour).groupBy(*KEYS).agg(F.max(F.struct((F.col("still") * F.exp(-F.col("d"))).alias("score"), "reason")).alias("m"))
    found = found.join(chosen.select(*KEYS), KEYS, "left_anti").select(*KEYS, F.round("m.score", 3).alias("score"), "m.reason")
    return found.orderBy(F.desc("score"), *KEYS).limit(most)


def aligned_teams(centres: DataFrame, reference: DataFrame, by_clips: bool = True) -> DataFrame:
    """Per clip whether its team codes are swapped: its shirt colours (team, lab) fit the reference's crosswise better, clearly so for stored colours. [STA-03, PRJ-05]"""
    two = lambda df, k: df.groupBy(*([k] if k else [])).agg(*[F.max(F.when(F.col("team") == t, F.col("lab"))).alias(f"l{t}") for t in (0, 1)])
    r = two(reference, None).withColumnsRenamed({"l0": "r0", "l1": "r1"})
    d = lambda a, b: F.sqrt(F.pow(0.5 * (F.col(a)[0] - F.col(b)[0]), 2) + F.pow(F.col(a)[1] - F.col(b)[1], 2) + F.pow(F.col(a)[2] - F.col(b)[2], 2))
    same, cross = d("l0", "r0") + d("l1", "r1"), d("l0", "r1") + d("l1", "r0")
    return two(centres, "clip_id").join(F.broadcast(r)).select("clip_id", F.coalesce(cross < same * (1.0 if by_clips else 0.7), F.lit(False)).alias("swapped"))  # one row


def team_centres(tracks: DataFrame, keys: list[str] = ["clip_id"]) -> DataFrame:  # noqa: B006
    """Weighted mean Lab and hex colour of each team (tracks: team, color as #rrggbb, n_frames). [AGG-13, AGG-14, AGG-15]"""
    rgb = parsing.rgb(F.col("color"))
    lab = parsing.lab([c.cast("double") for c in rgb])
    t = tracks.where(F.col("color").isNotNull() & F.col("team").isin(0, 1)).select(*keys, "team", F.coalesce(F.nullif("n_frames", F.lit(0)), F.lit(1)).alias("w"), *[c.alias(f"c{i}") for i, c in enumerate(rgb)], *[x.alias(f"l{i}") for i, x in enumerate(lab)])
    mean = lambda c: F.sum(F.col(c) * F.col("w")) / F.sum("w")
    g = t.groupBy(*keys, "team").agg(*[F.rint(mean(f"c{i}")).cast("int").alias(f"c{i}") for i in range(3)], F.array(*[mean(f"l{i}") for i in range(3)]).alias("lab"))
    return g.select(*keys, "team", "lab", parsing.hex_colour([F.col(f"c{i}") for i in range(3)]).alias("color"))


def teams_by_colour(tracks: DataFrame, seeds: int = 10) -> DataFrame:
    """A team for each track of a clip from its shirt (lab, n_frames): 0 that of the larger centre, 1 the other, 2 others (too far from both teams' colours, and not three times as near to one); -1 without
    a colour. One group is one clip's tracks. [STA-02, STA-01]

    The teams' colours are those of the tracks that were given a team by hand (manual_team, if known), where both teams have one; else weighted k-means with up to six centres, of which
    the pair with the most players and contrast; refined twice. Tracks that are `excluded` (they stand still) don't shape the colours, and must fit them better. With fewer than three others, all these are team 0.
    """
    weight = np.array([0.5, 1.0, 1.0])

    def centres(x: np.ndarray, w: np.ndarray, k: int) -> tuple[float, np.ndarray]:
        best = (np.inf, x[:1])
        for seed in range(seeds):
            r = np.random.default_rng(seed)
            c = x[r.choice(len(x), 1, p=w / w.sum())]
            while len(c) < k:
                d = ((x[:, None] - c[None]) ** 2).sum(2).min(1) * w
                c = np.vstack([c, x[r.choice(len(x), p=d / d.sum()) if d.sum() > 0 else r.integers(len(x))]])
            for _ in range(50):
                at = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
                new = np.array([np.average(x[at == i], axis=0, weights=w[at == i]) if (at == i).any() else c[i] for i in range(k)])
                if np.allclose(new, c):
                    break
                c = new
            cost = float((((x[:, None] - c[None]) ** 2).sum(2).min(1) * w).sum())
            best = min(best, (cost, c), key=lambda b: b[0])
        return best

    def mean(x: np.ndarray, w: np.ndarray, rows: np.ndarray, default: np.ndarray) -> np.ndarray:
        return np.average(x[rows], axis=0, weights=w[rows]) if rows.any() else default

    def assign(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("track_id").copy()
        team = np.full(len(g), -1)
        at = np.flatnonzero(g["lab"].notna())
        x = np.array([np.asarray(v, float) for v in g["lab"].iloc[at]]).reshape(-1, 3) * weight
        w = g["n_frames"].fillna(1).to_numpy(float)[at].clip(1)
        column = lambda name, default: g[name].iloc[at].to_numpy() if name in g else np.full(len(at), default, object)
        free = np.array([v is None or pd.isna(v) or not v for v in column("excluded", False)], bool)
        chosen = np.array([-1 if v is None or pd.isna(v) or v not in (0, 1) else int(v) for v in column("manual_team", None)], int)
        if free.sum() < 3:
            team[at] = np.where(free, 0, 2)
        else:
            two = None
            if (chosen == 0).any() and (chosen == 1).any():
                two = np.stack([mean(x, w, chosen == s, x[0]) for s in (0, 1)])
            else:
                c = centres(x[free], w[free], min(6, int(free.sum())))[1]
                of = ((x[free][:, None] - c[None]) ** 2).sum(2).argmin(1)
                size = np.bincount(of, weights=w[free], minlength=len(c))
                pairs = [(min(size[i], size[j]) * min(1.0, float(np.linalg.norm(c[i] - c[j])) / 30), -i, -j) for i in range(len(c)) for j in range(i + 1, len(c))]
                _, i, j = max(pairs)
                two = np.stack(sorted((c[-i], c[-j]), key=lambda v: -size[np.flatnonzero((c == v).all(1))[0]]))
            for _ in range(2):
                d = np.linalg.norm(x[:, None] - two[None], axis=2)
                side = np.where(d.min(1) < 0.4 * np.linalg.norm(two[0] - two[1]), d.argmin(1), -1)
                side = np.where(chosen >= 0, chosen, side)
                two = np.stack([mean(x, w, free & (side == s), two[s]) for s in (0, 1)])
            apart = float(np.linalg.norm(two[0] - two[1]))
            d = np.linalg.norm(x[:, None] - two[None], axis=2)
            near, far = d.min(1), d.max(1)
            sure = (near < np.where(free, 0.4, 0.35) * apart) | ((near < 0.45 * apart) & (far > 3 * near))
            team[at] = np.where(sure, d.argmin(1), 2)
        g["team_auto"] = team.astype("int32")
        return g

    return tracks.groupBy("clip_id").applyInPandas(assign, ", ".join([*[f"`{c}` {t}" for c, t in tracks.dtypes if c != "team_auto"], "team_auto int"]))
