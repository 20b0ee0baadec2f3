"""Queries of filters, lookups, orders and scalar rules on the driver's tables, next to their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackmill.functions import camera, geo
from trackmill.operators import choose
from trackmill.plans import order, roster, views
from trackmill.plans.registry import events, query, table

DAY = 86_400_000_000


@query(" SELECT event_id, us FROM b WHERE us BETWEEN 1704240000000000 AND 1704758400000000")
def time_range(spark, sf):
    """Events of a time range, both ends in. [FLT-01, QRY-03]"""
    return views.between(events(spark, sf), 1_704_240_000_000_000, 1_704_758_400_000_000, "us").select("event_id", "us")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')", events=False)
def done_with_accepted(spark, sf):
    """Parents of a state with an accepted child. [FLT-07, SRC-14]"""
    clips = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "done").alias("status"))
    keys = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("clip_id"), (F.col("l_returnflag") == "R").alias("accepted"))
    return views.analysed(clips, keys).select(F.col("id").alias("o_orderkey"))


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS s, c_nationkey % 4 AS team, CASE WHEN c_custkey % 5 = 0 THEN c_nationkey END AS p FROM customer)
 SELECT c_custkey FROM c WHERE coalesce(s, '') <> 'BUILDING' AND (p IS NOT NULL OR coalesce(team = 2, false) = false)""", events=False)
def null_aware_filters(spark, sf):
    """Rows whose state is not one, unknown ones kept; referees out unless linked. [FLT-06, FLT-08]"""
    c = table(spark, sf, "customer")
    c = c.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("s"), (F.col("c_nationkey") % 4).alias("team"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_nationkey")).alias("player_id"))
    return views.counted(c.where(F.coalesce("s", F.lit("")) != "BUILDING")).select("c_custkey")


@query(""", k AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY v DESC, event_id) AS r FROM b WHERE v >= CASE WHEN kind = 'view' THEN 5000 ELSE 2000 END)
 SELECT user_id, day, event_id, v FROM k WHERE r = 1""")
def confident_best(spark, sf):
    """Candidates over their kind's threshold, the surest of each frame. [FLT-09]"""
    e = events(spark, sf).where(F.col("v") >= F.when(F.col("kind") == "view", 5000).otherwise(2000))
    best = e.groupBy("user_id", "day").agg(F.max_by(F.struct("event_id", "v"), F.struct("v", (-F.col("event_id")).alias("i"))).alias("m"))
    return best.select("user_id", "day", "m.event_id", "m.v")


@query(", k AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS idx FROM b) SELECT event_id, user_id, idx FROM k WHERE idx % 3 = 0")
def strided(spark, sf):
    """Every third sample of each series. [FLT-11]"""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    return events(spark, sf).select("event_id", "user_id", (F.row_number().over(w) - 1).cast("long").alias("idx")).where("idx % 3 = 0")


@query(""", k AS (SELECT event_id, user_id % 10 AS team, row_number() OVER (PARTITION BY user_id % 10 ORDER BY CASE WHEN kind = 'purchase' THEN 0 ELSE 1 END, v DESC, event_id) AS r FROM b WHERE kind IN ('purchase', 'error'))
 SELECT event_id, team, r AS place FROM k WHERE r <= 80""")
def event_list(spark, sf):
    """A list of at most 80 entries a group, one kind first, then by score. [FLT-14, TOP-02, TOP-14]"""
    w = Window.partitionBy("team").orderBy(F.when(F.col("kind") == "purchase", 0).otherwise(1), F.desc("v"), "event_id")
    e = events(spark, sf).where(F.col("kind").isin("purchase", "error")).select("event_id", (F.col("user_id") % 10).alias("team"), "kind", "v")
    return e.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 80").select("event_id", "team", "place")


@query("""SELECT c_custkey AS track_id, coalesce(n_regionkey, c_custkey % 3) AS team, CASE WHEN c_nationkey % 2 = 0 AND c_nationkey > 0 THEN 'p' || c_nationkey ELSE 'c' || (c_custkey % 7) || 't' || c_custkey END AS entity
 FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND c_nationkey % 2 = 0""", events=False)
def team_override(spark, sf):
    """Tracks with the linked player's team, else their own, and their entity. [JOI-02, JOI-03, PRJ-04, STA-04]"""
    t = table(spark, sf, "customer").select((F.col("c_custkey") % 7).alias("clip_id"), F.col("c_custkey").alias("track_id"), (F.col("c_custkey") % 3).cast("int").alias("team"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey")).alias("player_id"))
    p = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("team"), F.col("n_name").alias("name"))
    return views.teams(t, p).select("track_id", F.col("team").cast("long").alias("team"), "entity")


@query("""WITH d AS (SELECT l_orderkey AS clip, l_linenumber AS idx, CAST(l_quantity AS BIGINT) AS x, CAST(l_partkey % 100 AS BIGINT) AS y FROM lineitem), h AS (SELECT o_orderkey AS clip, o_orderkey % 5 + 1 AS a FROM orders)
 SELECT clip, idx, x * a AS px, y * a + 3 AS py, count(*) AS n FROM d JOIN h USING (clip) GROUP BY ALL""", events=False)
def projected_rows(spark, sf):
    """Rows joined with their group's factor and scaled by it. [§2.16]"""
    d = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("clip"), F.col("l_linenumber").alias("idx"), F.col("l_quantity").cast("long").alias("x"), (F.col("l_partkey") % 100).alias("y"))
    h = table(spark, sf, "orders").select(F.col("o_orderkey").alias("clip"), (F.col("o_orderkey") % 5 + 1).alias("a"))
    return d.join(h, "clip").groupBy("clip", "idx", (F.col("x") * F.col("a")).alias("px"), (F.col("y") * F.col("a") + 3).alias("py")).agg(F.count("*").alias("n"))


@query(""", d AS (SELECT user_id, us, event_id, v FROM b WHERE kind = 'purchase'), q AS (SELECT user_id, event_id AS asked_id, us AS asked FROM b WHERE kind = 'view'),
 m AS (SELECT q.user_id, q.asked_id, q.asked, max(d.us) AS us FROM q JOIN d ON d.user_id = q.user_id AND d.us <= q.asked GROUP BY ALL)
 SELECT m.asked_id, d.event_id FROM m JOIN d ON d.user_id = m.user_id AND d.us = m.us WHERE m.asked - m.us < 86400000000""")
def latest_group(spark, sf):
    """For each asked time all rows of the latest time at or before it, less than a day old. [JOI-25, JOI-26]"""
    e = events(spark, sf)
    d = e.where("kind = 'purchase'").select(F.col("user_id").alias("clip_id"), F.col("us").alias("t"), "event_id")
    at = e.where("kind = 'view'").select(F.col("user_id").alias("clip_id"), F.col("us").alias("asked"), F.col("event_id").alias("asked_id"))
    shown = views.shown_boxes(d, at, DAY)
    return at.join(shown, ["clip_id", "asked"]).select("asked_id", "event_id")


@query(""", s AS (SELECT user_id, us, v, event_id FROM b WHERE kind = 'purchase'), q AS (SELECT DISTINCT user_id, us AS asked FROM b WHERE kind = 'click'),
 p AS (SELECT q.user_id, asked, max(s.us) AS t0 FROM q JOIN s ON s.user_id = q.user_id AND s.us < asked GROUP BY ALL), n AS (SELECT q.user_id, asked, min(s.us) AS t1 FROM q JOIN s ON s.user_id = q.user_id AND s.us >= asked GROUP BY ALL),
 j AS (SELECT q.user_id, q.asked, t0, t1, a.v AS v0, c.v AS v1 FROM q LEFT JOIN p USING (user_id, asked) LEFT JOIN n USING (user_id, asked) LEFT JOIN s a ON a.user_id = q.user_id AND a.us = t0 LEFT JOIN s c ON c.user_id = q.user_id AND c.us = t1),
 r AS (SELECT user_id, asked, CASE WHEN t1 - t0 <= 172800000000 THEN (1 - (asked - t0)::DOUBLE / (t1 - t0)::DOUBLE) * v0 + (asked - t0)::DOUBLE / (t1 - t0)::DOUBLE * v1 WHEN coalesce(asked - t0, 9000000000000000) <= coalesce(t1 - asked, 9000000000000000) THEN CASE WHEN asked - t0 <= 43200000000 THEN v0 END WHEN t1 - asked <= 43200000000 THEN v1 END AS x FROM j)
 SELECT user_id, asked, CAST(round(x * 10) AS BIGINT) AS x10 FROM r WHERE x IS NOT NULL""")
def value_at_time(spark, sf):
    """Values between the samples around a time, else the nearest sample's. [WIN-21]"""
    e = events(spark, sf)
    names = [F.col("v").cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    s = e.where("kind = 'purchase'").select(F.col("user_id").alias("clip_id"), F.col("us").cast("double").alias("t"), *names)
    at = e.where("kind = 'click'").select(F.col("user_id").alias("clip_id"), F.col("us").cast("double").alias("asked")).distinct()
    out = views.box_at(s, at, 2.0 * DAY, 0.5 * DAY)
    return out.select(F.col("clip_id").alias("user_id"), F.col("asked").cast("long").alias("asked"), F.round(F.col("x1") * 10).cast("long").alias("x10"))


CLIPS = """, c AS (SELECT event_id AS id, user_id AS match_id, CASE WHEN v % 7 = 0 THEN NULL ELSE us / 1000000.0 END AS rec, v / 10.0 AS duration, v AS order_idx FROM b WHERE kind = 'view')"""


def _clips(spark, sf):
    e = events(spark, sf).where("kind = 'view'")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("match_id"), F.when(F.col("v") % 7 != 0, F.col("us") / 1e6).alias("rec_start"), (F.col("v") / 10).alias("duration"), F.col("v").alias("order_idx"), F.lit(1).alias("period"), F.lit(0.0).alias("start_minute"))


@query(CLIPS + """, k AS (SELECT *, row_number() OVER w - 1 AS k, rec - (lag(rec) OVER w + coalesce(lag(duration) OVER w, 0)) AS gap FROM c WHERE rec IS NOT NULL WINDOW w AS (PARTITION BY match_id ORDER BY rec, order_idx, id)),
 g AS (SELECT match_id, k AS cut FROM (SELECT match_id, k, row_number() OVER (PARTITION BY match_id ORDER BY gap DESC, k) AS r FROM k WHERE gap >= 480) WHERE r = 1),
 n AS (SELECT match_id, count(*) AS n FROM k GROUP BY match_id)
 SELECT id, k AS place, CASE WHEN k >= cut THEN 2 ELSE 1 END AS period FROM k LEFT JOIN g USING (match_id)
 UNION ALL SELECT id, coalesce(n, 0) + row_number() OVER (PARTITION BY match_id ORDER BY order_idx, id) - 1, 1 FROM c LEFT JOIN n USING (match_id) WHERE rec IS NULL""")
def recording_order(spark, sf):
    """Place and half of each clip from recording times; unknown times last. [QRY-09, WIN-14, WIN-15]"""
    return order.proposed(_clips(spark, sf)).select("id", F.col("place").cast("long").alias("place"), "period")


@query(CLIPS + """, s AS (SELECT match_id, min(rec) AS t1, max(CASE WHEN id % 5 = 0 THEN id END) AS second FROM c WHERE rec IS NOT NULL GROUP BY match_id), r AS (SELECT c.*, t1, second, (SELECT x.rec FROM c x WHERE x.id = second) AS t2 FROM c JOIN s USING (match_id))
 SELECT id, row_number() OVER (PARTITION BY match_id ORDER BY rec NULLS LAST, order_idx, id) - 1 AS place, CASE WHEN rec >= t2 THEN 2 ELSE 1 END AS period,
  CAST(round(10 * CASE WHEN rec IS NULL THEN 0 WHEN rec >= t2 THEN 45 + (rec - t2) / 60 ELSE (rec - t1) / 60 END) AS BIGINT) AS tenths FROM r""")
def match_timeline(spark, sf):
    """Order, half and minute from the clip that begins the second half. [WIN-16, SRC-16]"""
    c = _clips(spark, sf)
    s = c.where("rec_start is not null").groupBy("match_id").agg(F.max(F.when(F.col("id") % 5 == 0, F.col("id"))).alias("second_clip"), F.lit(None).cast("double").alias("kickoff"), F.lit(None).cast("double").alias("kickoff2"), F.lit(45).alias("half_length"))
    return order.timed(c.join(s.select("match_id"), "match_id", "left_semi"), s).select("id", F.col("place").cast("long").alias("place"), "period", F.round(F.col("start_minute") * 10).cast("long").alias("tenths"))


@query("""SELECT c_nationkey AS match_id, CAST(coalesce(sum(CASE WHEN c_custkey % 2 = 0 THEN c_nationkey * 10 END), 0) AS BIGINT) AS seconds FROM customer GROUP BY c_nationkey""", events=False)
def total_durations(spark, sf):
    """Summed durations, 0 where none is known. [AGG-21]"""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("match_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey") * 10.0).alias("duration"))
    return roster.durations(c).select("match_id", F.col("seconds").cast("long").alias("seconds"))


@query(""", s AS (SELECT user_id AS job, arg_max(kind, (us, event_id)) AS state, arg_max(v, (us, event_id)) AS progress FROM b GROUP BY user_id)
 SELECT count(*) AS jobs, count(*) FILTER (WHERE state = 'view') AS waiting, count(*) FILTER (WHERE state = 'click') AS running, count(*) FILTER (WHERE state = 'purchase') AS done, CAST(round(1000 * avg(CASE state WHEN 'purchase' THEN 1 WHEN 'click' THEN progress / 10000.0 ELSE 0 END)) AS BIGINT) AS permille FROM s""")
def job_overview(spark, sf):
    """Jobs per last reported state and their mean progress. [QRY-17, AGG-23, AGG-33, AGG-34, SNK-13]"""
    e = events(spark, sf)
    state = F.when(F.col("kind") == "view", "waiting").when(F.col("kind") == "click", "running").when(F.col("kind") == "purchase", "done").otherwise("failed")
    ups = e.select(F.col("user_id").alias("job_id"), state.alias("state"), (F.col("v") / 10_000).alias("progress"), F.struct("us", "event_id").alias("at"))
    o = roster.overview(e.select(F.col("user_id").alias("job_id")).distinct(), ups)
    return o.select("jobs", "waiting", "running", "done", F.round(F.col("progress") * 1000).cast("long").alias("permille"))


@query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey DESC) AS r FROM part WHERE p_size % 4 <> 0) WHERE r = 1", events=False)
def active_versions(spark, sf):
    """The last activated version of each kind. [SNK-14]"""
    p = table(spark, sf, "part").where("p_size % 4 <> 0")
    return choose.latest(p, ["p_brand"], ["p_size", "p_partkey"]).select("p_brand", "p_partkey")


@query("""SELECT p_partkey, (b > o + 0.01 AND p >= q - 0.02) OR (p > q + 0.02 AND b >= o - 0.01) AS better, CAST(greatest(1, ceil(p_size * 8 * 0.55 / 60)) AS INTEGER) AS minutes
 FROM (SELECT p_partkey, p_size, (p_partkey % 16) / 16.0 AS b, (p_partkey % 8) / 8.0 AS o, (p_size % 16) / 16.0 AS p, (p_size % 4) / 4.0 AS q FROM part)""", events=False)
def model_gate(spark, sf):
    """Whether a new model is better at one kind and not worse at the other, and how long a training takes. [STA-15, AGG-35]"""
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", camera.better_model(k % 16 / 16, k % 8 / 8, s % 16 / 16, s % 4 / 4).alias("better"), camera.time_estimate(s, F.lit(8), 0.55).alias("minutes"))


@query("""WITH p AS (SELECT c_custkey, 52 + c_custkey / 100000.0 AS lat, 5 + c_nationkey / 1000.0 AS lon, CAST(c_custkey % 9 AS DOUBLE) AS acc FROM customer)
 SELECT c_custkey, CAST(round(radians(lon - 5) * 6371000 * cos(radians(52)) * 100) AS BIGINT) AS east, CAST(round(radians(lat - 52) * 6371000 * 100) AS BIGINT) AS north,
  CAST(round(10 * CASE WHEN abs(lat * 1e4 - round_even(lat * 1e4, 0)) < 1e-6 AND abs(lon * 1e4 - round_even(lon * 1e4, 0)) < 1e-6 THEN sqrt(acc * acc + power(5.566, 2) + power(5.566 * cos(radians(lat)), 2)) ELSE acc END) AS BIGINT) AS tenths FROM p""", events=False)
def gps_places(spark, sf):
    """Positions in metres around a point and how far off they may be. [SFN-08, SFN-11]"""
    p = table(spark, sf, "customer").select("c_custkey", (52 + F.col("c_custkey") / 100_000).alias("lat"), (5 + F.col("c_nationkey") / 1000).alias("lon"), (F.col("c_custkey") % 9).cast("double").alias("acc"))
    east, north = geo.local_metres(F.col("lat"), F.col("lon"), F.lit(52.0), F.lit(5.0))
    return p.select("c_custkey", F.round(east * 100).cast("long").alias("east"), F.round(north * 100).cast("long").alias("north"), F.round(geo.effective_accuracy(F.col("lat"), F.col("lon"), F.col("acc")) * 10).cast("long").alias("tenths"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 100 ELSE least(400, greatest(100, p_size * 10)) END AS weight, greatest(0, 2 * p_size) AS size FROM part""", events=False)
def click_weights(spark, sf):
    """Weights of clicks by zoom, and the larger side of a box. [SFN-40, SFN-33]"""
    zoom = F.when(F.col("p_size") % 5 != 0, (F.col("p_size") / 10).cast("string"))
    size = camera.candidate(F.lit(0), F.lit(0), F.col("p_size"), 2 * F.col("p_size"))[2]
    return table(spark, sf, "part").select("p_partkey", F.round(camera.click_weight(zoom) * 100).cast("int").alias("weight"), size.alias("size"))


@query(""", h AS (SELECT user_id, day, count(*) AS n FROM b GROUP BY ALL) SELECT user_id, day, CAST(round(1000 * sqrt(n / max(n) OVER (PARTITION BY user_id)::DOUBLE)) AS BIGINT) AS shade FROM h""")
def heat_shades(spark, sf):
    """Shades of a heat map's cells by the largest. [SFN-39]"""
    h = events(spark, sf).groupBy("user_id", "day").agg(F.count("*").alias("n"))
    return h.select("user_id", "day", F.round(1000 * camera.heat_shade(F.col("n"), F.max("n").over(Window.partitionBy("user_id")))).cast("long").alias("shade"))


@query("""WITH n AS (SELECT c_nationkey % 5 AS a, c_nationkey AS b, count(*) AS n FROM customer GROUP BY ALL), s AS (SELECT n_nationkey AS e, n_regionkey AS team, n_nationkey * 2 AS x FROM nation)
 SELECT n.a AS from_owner, n.b AS to_owner, p.team, p.x AS from_x, q.x AS to_x, CAST(round(100 * (1 + 7 * n.n / (SELECT max(n) FROM n)::DOUBLE)) AS BIGINT) AS width FROM n JOIN s p ON p.e = n.a JOIN s q ON q.e = n.b""", events=False)
def pass_arrows(spark, sf):
    """Edges with both ends' places, the first one's team and a width by the largest count. [JOI-29, JOI-28, AGG-27]"""
    n = table(spark, sf, "customer").groupBy((F.col("c_nationkey") % 5).alias("from_owner"), F.col("c_nationkey").alias("to_owner")).agg(F.count("*").alias("n"))
    s = table(spark, sf, "nation").select(F.col("n_nationkey").alias("entity"), F.col("n_regionkey").alias("team"), (F.col("n_nationkey") * 2).alias("avg_x"), F.lit(0).alias("avg_y"))
    out = views.pass_arrows(n, s)
    return out.select("from_owner", "to_owner", "team", F.col("from_owner_x").alias("from_x"), F.col("to_owner_x").alias("to_x"), F.round(F.col("width") * 100).cast("long").alias("width"))


@query("""SELECT c_custkey AS id, CAST(coalesce(CASE WHEN c_nationkey % 3 = 0 THEN n_regionkey END, CASE WHEN c_custkey % 4 = 0 THEN c_custkey * 2 END) AS BIGINT) AS emb
 FROM customer LEFT JOIN nation ON lower(trim(n_name)) = lower(trim(' ' || n_name || ' ')) AND n_nationkey = c_nationkey AND c_nationkey % 3 = 0""", events=False)
def profile_lookup(spark, sf):
    """The profile by squad and name, else by player. [JOI-27, JOI-21]"""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    players = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")).alias("name"), F.lit(1).alias("match_id"), F.col("c_nationkey").alias("team"))
    squads = n.where("n_nationkey % 3 = 0").select(F.lit(1).alias("match_id"), F.col("n_nationkey").alias("team"), F.col("n_nationkey").alias("squad_id"))
    profiles = n.select(F.col("n_nationkey").alias("squad_id"), F.upper("n_name").alias("name"), F.lit(None).cast("long").alias("match_player_id"), F.col("n_regionkey").cast("long").alias("emb")).unionByName(
        c.where("c_custkey % 4 = 0").select(F.lit(None).cast("int").alias("squad_id"), F.lit(None).cast("string").alias("name"), F.col("c_custkey").alias("match_player_id"), (F.col("c_custkey") * 2).alias("emb"))
    )
    return roster.profiles_of(players, profiles, squads).select("id", "emb")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [doc_id, doc_id + 1] WHEN doc_id % 3 = 1 THEN [doc_id] ELSE [] END AS players FROM documents""", events=False)
def moment_lists(spark, sf):
    """Lists from JSON text, old rows with one number, others empty. [SRC-06, SRC-13, SFN-34]"""
    d = table(spark, sf, "documents")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("["), "doc_id", F.lit(","), F.col("doc_id") + 1, F.lit("]"))).when(F.col("doc_id") % 3 == 1, F.col("doc_id").cast("string"))
    m = d.select("doc_id", F.lit(1).alias("clip_id"), text.alias("players"), F.lit(0.0).alias("t_start"), F.col("doc_id").alias("id"))
    clips = spark.range(1).select(F.lit(1).alias("id"), F.lit(1).alias("match_id"), F.lit(0).alias("order_idx"))
    return views.moments(m, clips).select("doc_id", "players")
