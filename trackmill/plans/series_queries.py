"""Sequence queries: segments, movement, runs, passes, repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackmill.operators import sequences as s
from trackmill.plans.registry import events, query

HOUR = 3_600_000_000


@query(""", r AS (SELECT *, CASE WHEN user_id IS DISTINCT FROM lag(user_id) OVER w THEN 1 ELSE 0 END AS st FROM b WINDOW w AS (PARTITION BY day ORDER BY us, event_id)),
 i AS (SELECT *, sum(st) OVER (PARTITION BY day ORDER BY us, event_id) AS run FROM r),
 g AS (SELECT day, user_id, run, min(us) AS t0, max(us) AS t1 FROM i GROUP BY ALL),
 p AS (SELECT *, user_id % 2 AS team, lead(user_id) OVER w AS nu, lead(t0) OVER w - t1 AS gap FROM g WINDOW w AS (PARTITION BY day ORDER BY t0, run))
 SELECT team, count(*) AS passes, count(*) FILTER (WHERE nu % 2 = team) AS passes_ok FROM p WHERE nu <> user_id AND gap <= 600000000 GROUP BY team""")
def team_passes(spark, sf):
    """Passes and their success by team, over owner runs per day. [WIN-05, WIN-07, AGG-07]"""
    runs = s.runs(events(spark, sf), ["day"], "us", "event_id", "user_id")
    found = s.passes(runs, ["day"], "user_id", F.col("user_id") % 2, 600_000_000)
    return found.groupBy("team").agg(F.count("*").alias("passes"), F.sum("ok").cast("long").alias("passes_ok"))


@query(""", r AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w > 21600000000 THEN 1 ELSE 0 END AS st FROM b WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
 i AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY us, event_id) AS segment FROM r),
 n AS (SELECT *, count(*) OVER (PARTITION BY user_id, segment) AS c FROM i)
 SELECT user_id, CAST(segment AS BIGINT) AS segment, count(*) AS n, min(us) AS t0, max(us) AS t1 FROM n WHERE c >= 2 GROUP BY ALL""")
def segment_series(spark, sf):
    """Segments of a user's events without a pause over six hours. [WIN-01]"""
    cut = s.segments(events(spark, sf), ["user_id"], "us", "event_id", 6 * HOUR)
    return cut.groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.min("us").alias("t0"), F.max("us").alias("t1"))


@query(""", d AS (SELECT user_id, us - lag(us) OVER w AS dt, abs(v - lag(v) OVER w) AS dv FROM b WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
 SELECT user_id, CAST(coalesce(sum(dv) FILTER (WHERE dv * 3600000000 <= 5000 * dt), 0) AS BIGINT) AS distance,
 CAST(coalesce(sum(dt), 0) AS BIGINT) AS us_seen, count(*) FILTER (WHERE dv * 3600000000 > 5000 * dt) AS too_fast FROM d GROUP BY user_id""")
def movement_by_entity(spark, sf):
    """Distance over steps of plausible speed; the time of implausible ones still counts. [WIN-03, AGG-01]"""
    d = s.steps(events(spark, sf), ["user_id"], ["us", "event_id"], "us", ["v"]).withColumn("dv", F.abs("d_v"))
    slow = F.col("dv") * HOUR <= 5000 * F.col("dt")
    return d.groupBy("user_id").agg(
        F.coalesce(F.sum(F.when(slow, F.col("dv"))), F.lit(0)).alias("distance"), F.coalesce(F.sum("dt"), F.lit(0)).alias("us_seen"), F.count_if(~slow).alias("too_fast")
    )


@query(""", d AS (SELECT *, lag(us) OVER w AS before, coalesce(abs(v - lag(v) OVER w) * 3600000000 > 500 * (us - lag(us) OVER w), false) AS fast FROM b WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
 f AS (SELECT *, CASE WHEN fast IS DISTINCT FROM lag(fast) OVER w THEN 1 ELSE 0 END AS st FROM d WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
 i AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY us, event_id) AS run FROM f)
 SELECT user_id, min(before) AS t0, max(us) AS t1, count(*) AS steps FROM i WHERE fast GROUP BY user_id, run HAVING max(us) - min(before) >= 7200000000""")
def sprint_runs(spark, sf):
    """Runs of fast steps lasting two hours or more. [WIN-04]"""
    d = s.steps(events(spark, sf), ["user_id"], ["us", "event_id"], "us", ["v"])
    fast = F.abs("d_v") * HOUR > 500 * F.col("dt")
    return s.fast_runs(d, ["user_id"], ["us", "event_id"], "us", fast, 2 * HOUR)


@query(""", k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i, least(5, count(*) OVER (PARTITION BY user_id)) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM b),
 x AS (SELECT a.event_id, a.user_id, a.n, unnest(range(-(a.n // 2), a.n - a.n // 2)) AS o, a.i, a.c FROM k a)
 SELECT x.event_id, x.user_id, CAST(sum(k.v) AS BIGINT) AS total, CAST(x.n AS BIGINT) AS n FROM x JOIN k ON k.user_id = x.user_id AND k.i = greatest(1, least(x.c, x.i + x.o)) GROUP BY x.event_id, x.user_id, x.n""")
def edge_padded_smooth(spark, sf):
    """Edge-padded moving sums over five events of a user. [WIN-02]"""
    w = s.smoothed(events(spark, sf), ["user_id"], ["us", "event_id"], "v")
    return w.select("event_id", "user_id", F.col("smooth_sum").cast("long").alias("total"), F.col("smooth_n").cast("long").alias("n"))


POSSESSION = """, r AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER w THEN 1 ELSE 0 END AS st FROM b WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
 i AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY us, event_id) AS run FROM r),
 g AS (SELECT user_id, kind, run, min(us) AS t0, max(us) AS t1, min(event_id) AS tie, count(*) AS n FROM i GROUP BY ALL HAVING count(*) >= 2),
 m AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER w OR t0 - lag(t1) OVER w > 86400000000 THEN 1 ELSE 0 END AS st FROM g WINDOW w AS (PARTITION BY user_id ORDER BY t0, tie)),
 q AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY t0, tie) AS k FROM m),
 z AS (SELECT user_id, kind, min(t0) AS t0, max(t1) AS t1, CAST(sum(n) AS BIGINT) AS n FROM q GROUP BY user_id, kind, k)"""


def possession(spark, sf):
    runs = s.runs(events(spark, sf), ["user_id"], "us", "event_id", "kind", least=2)
    return s.merged(runs, ["user_id"], "kind", 24 * HOUR)


@query(POSSESSION + " SELECT * FROM z")
def possession_runs(spark, sf):
    """Runs of two events or more of one kind, joined over at most a day. [WIN-05, WIN-06]"""
    return possession(spark, sf).select("user_id", "kind", "t0", "t1", "n")


@query(POSSESSION + " SELECT kind, CAST(sum(t1 - t0) AS BIGINT) AS us, CAST(sum(n) AS BIGINT) AS touches, CAST((1000000 * (sum(t1 - t0) // 1000000)) // (sum(sum(t1 - t0)) OVER () // 1000000) AS BIGINT) AS share_ppm FROM z GROUP BY kind")
def possession_share(spark, sf):
    """Time in possession by kind, and its share in parts per million. [AGG-05, AGG-06]"""
    by = possession(spark, sf).groupBy("kind").agg(F.sum(F.col("t1") - F.col("t0")).alias("us"), F.sum("n").alias("touches"))
    whole = by.agg(F.sum("us").alias("whole"))
    return by.join(F.broadcast(whole)).select("kind", "us", "touches", F.expr("(1000000 * (us div 1000000)) div (whole div 1000000)").alias("share_ppm"))


@query(""", r AS (SELECT *, CASE WHEN user_id IS DISTINCT FROM lag(user_id) OVER w THEN 1 ELSE 0 END AS st FROM b WINDOW w AS (PARTITION BY day ORDER BY us, event_id)),
 i AS (SELECT *, sum(st) OVER (PARTITION BY day ORDER BY us, event_id) AS run FROM r),
 g AS (SELECT day, user_id, run, min(us) AS t0, max(us) AS t1 FROM i GROUP BY ALL),
 p AS (SELECT *, lead(user_id) OVER w AS nu, lead(t0) OVER w - t1 AS gap FROM g WINDOW w AS (PARTITION BY day ORDER BY t0, run))
 SELECT user_id AS from_owner, nu AS to_owner, count(*) AS passes FROM p WHERE nu <> user_id AND gap <= 600000000 AND nu % 2 = user_id % 2 GROUP BY ALL""")
def pass_network(spark, sf):
    """Successful passes between each pair. [AGG-08]"""
    runs = s.runs(events(spark, sf), ["day"], "us", "event_id", "user_id")
    found = s.passes(runs, ["day"], "user_id", F.col("user_id") % 2, 600_000_000)
    return found.where("ok = 1").groupBy("from_owner", "to_owner").agg(F.count("*").alias("passes"))


@query(""", n AS (SELECT *, lag(us) OVER w AS t0, lag(v) OVER w AS v0, lead(us) OVER w AS t2, lead(v) OVER w AS v2 FROM b WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
 h AS (SELECT *, us // 3600000000 AS h1, t0 // 3600000000 AS h0, t2 // 3600000000 AS h2 FROM n),
 c AS (SELECT *, coalesce(abs(v - v0) > 400 * (h1 - h0) AND abs(v2 - v) > 400 * (h2 - h1) AND NOT abs(v2 - v0) > 400 * (h2 - h0) AND h1 - h0 <= 24 AND h2 - h1 <= 24, false) AS raw FROM h),
 r AS (SELECT *, CASE WHEN raw IS DISTINCT FROM lag(raw) OVER w THEN 1 ELSE 0 END AS st FROM c WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
 i AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM r),
 z AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY us, event_id) AS p FROM i)
 SELECT event_id, user_id, v FROM z WHERE NOT (raw AND p % 2 = 1)""")
def despike(spark, sf):
    """Events without single outliers of the value, on an hourly clock. [WIN-08]"""
    e = events(spark, sf).withColumn("hour", F.expr(f"us div {HOUR}"))
    return s.despiked(e, ["user_id"], ["us", "event_id"], "hour", "v", 400, 24).where(~F.col("spike")).select("event_id", "user_id", "v")


@query(""", h AS (SELECT user_id, us // 3600000000 AS g, max(v) AS v FROM b GROUP BY ALL),
 n AS (SELECT *, lead(g) OVER w AS g2, lead(v) OVER w AS v2 FROM h WINDOW w AS (PARTITION BY user_id ORDER BY g)),
 x AS (SELECT *, unnest(range(g + 1, g2)) AS p FROM n WHERE g2 - g > 1 AND g2 - g <= 6)
 SELECT user_id, p AS g, v * (g2 - p) + v2 * (p - x.g) AS numerator, g2 - x.g AS divisor FROM x""")
def fill_gaps(spark, sf):
    """Hours interpolated between a user's hours at most six apart. [WIN-09, JOI-24]"""
    h = events(spark, sf).groupBy("user_id", F.expr(f"us div {HOUR}").alias("g")).agg(F.max("v").alias("v"))
    return s.filled(h, ["user_id"], "g", "v", 6)


@query(""", c AS (SELECT * FROM b WHERE v > 5000), r AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w > 172800000000 OR kind <> lag(kind) OVER w THEN 1 ELSE 0 END AS st FROM c WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
 i AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session FROM r)
 SELECT user_id, CAST(session AS BIGINT) AS session, min(us) AS t0, max(us) AS t1, count(*) AS n, arg_min(event_id, us) AS head FROM i GROUP BY user_id, session""")
def shot_sessions(spark, sf):
    """Candidates merged into sessions while they follow within two days and agree in kind. [WIN-10]"""
    return s.sessions(events(spark, sf).where("v > 5000"), ["user_id"], "us", "event_id", 48 * HOUR, "kind")


@query(""", h AS (SELECT kind, us // 3600000000 AS g, sum(v) AS v FROM b GROUP BY ALL), m AS (SELECT * FROM h WHERE v > 15000),
 r AS (SELECT *, CASE WHEN lag(g) OVER w IS NULL OR g - lag(g) OVER w > 3 THEN 1 ELSE 0 END AS st FROM m WINDOW w AS (PARTITION BY kind ORDER BY g)),
 i AS (SELECT *, sum(st) OVER (PARTITION BY kind ORDER BY g) AS k FROM r)
 SELECT kind, min(g) AS first, max(g) AS last, count(*) AS n FROM i GROUP BY kind, k""")
def mask_groups(spark, sf):
    """Groups of busy hours at most three apart. [WIN-12]"""
    h = events(spark, sf).groupBy("kind", F.expr(f"us div {HOUR}").alias("g")).agg(F.sum("v").alias("v"))
    return s.mask_groups(h, ["kind"], "g", F.col("v") > 15000, 3)


@query(""" SELECT event_id, user_id, quantile_cont(v, 0.5) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS median FROM b""")
def rolling_median_baseline(spark, sf):
    """Median over 31 events of a user. [WIN-13]"""
    return s.rolling_median(events(spark, sf), ["user_id"], ["us", "event_id"], "v").select("event_id", "user_id", "median")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) // 86400000000 AS d FROM orders),
 g AS (SELECT *, d - lag(d + 1) OVER (PARTITION BY o_custkey ORDER BY d, o_orderkey) AS gap FROM o),
 r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY gap DESC, d, o_orderkey) AS k FROM g WHERE gap >= 30)
 SELECT o_custkey, o_orderkey, d AS day, gap FROM r WHERE k = 1""", events=False)
def largest_gap_split(spark, sf):
    """Each customer's longest pause between orders. [WIN-14, WIN-15]"""
    from trackmill.plans.registry import table

    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)").alias("day"))
    o = o.withColumn("end", F.col("day") + 1)
    return s.largest_gap(o, ["o_custkey"], "day", "end", "o_orderkey", 30).select("o_custkey", "o_orderkey", "day", "gap")


@query(""", k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS u, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS d FROM b)
 SELECT user_id, min(us) AS t0, max(us) AS t1, count(*) AS n, quantile_cont(v, 0.5) FILTER (WHERE u <= 5) AS head_median, quantile_cont(v, 0.5) FILTER (WHERE d <= 5) AS tail_median FROM k GROUP BY user_id""")
def track_ends(spark, sf):
    """First and last times with the medians of five values at each end. [WIN-18, AGG-12]"""
    return s.ends(events(spark, sf), ["user_id"], "us", "event_id", "v")


@query(""", k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM b),
 t AS (SELECT DISTINCT user_id, (i * (n - 1)) // 9 AS k FROM k, range(10) r(i))
 SELECT k.event_id, k.user_id FROM k JOIN t USING (user_id, k)""")
def even_thinning(spark, sf):
    """Ten events of each user at even distances. [FLT-12]"""
    return s.thinned(events(spark, sf), ["user_id"], ["us", "event_id"], 10).select("event_id", "user_id")


@query(""", s AS (SELECT user_id, min(us) AS a, max(us) AS z FROM b GROUP BY user_id),
 g AS (SELECT user_id, a + ((z - a) * i) // 199 AS g FROM s, range(200) r(i)),
 h AS (SELECT g.user_id, g.g, min(abs(b.us - g.g)) AS d FROM g JOIN b ON b.user_id = g.user_id GROUP BY ALL)
 SELECT g.user_id, count(*) FILTER (WHERE h.d <= 21600000000) AS covered, count(*) AS points FROM g JOIN h ON g.user_id = h.user_id AND g.g = h.g GROUP BY g.user_id""")
def coverage_share(spark, sf):
    """Of 200 even times of each user, those within six hours of an event. [WIN-22]"""
    return s.coverage(events(spark, sf), ["user_id"], "us", 200, 6 * HOUR)
