"""Time joins, ranking, sets and summaries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackmill.functions import geometry, vectors
from trackmill.operators import choose, timejoins
from trackmill.plans.registry import events, query, table

HOUR = 3_600_000_000


@query(""", p AS (SELECT user_id, us, max(v) AS v FROM b WHERE kind = 'purchase' GROUP BY ALL),
 c AS (SELECT event_id, user_id, us FROM b WHERE kind = 'click')
 SELECT c.event_id, p.us AS found_us, p.v AS found_v FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.us >= p.us""")
def asof_backward(spark, sf):
    """Each click with the user's last purchase before. [JOI-26]"""
    e = events(spark, sf)
    out = timejoins.as_of(e.where("kind = 'click'").select("event_id", "user_id", "us"), e.where("kind = 'purchase'"), ["user_id"], "us", "v")
    return out.select("event_id", F.col("found.t").alias("found_us"), F.col("found.v").alias("found_v"))


@query(""", j AS (SELECT a.event_id, a.us, b2.us AS t, b2.v, row_number() OVER (PARTITION BY a.event_id ORDER BY b2.us, b2.event_id) AS k
 FROM b a LEFT JOIN b b2 ON a.user_id = b2.user_id AND b2.us >= a.us + 86400000000) SELECT event_id, t AS later_us FROM j WHERE k = 1""")
def asof_forward(spark, sf):
    """Each event with the user's first one a day or more later. [JOI-06]"""
    out = timejoins.later_sample(events(spark, sf), ["user_id"], "us", "event_id", "v", 24 * HOUR)
    return out.select("event_id", F.col("later.t").alias("later_us"))


@query(""", j AS (SELECT a.event_id, a.us, b2.us AS t, row_number() OVER (PARTITION BY a.event_id ORDER BY b2.us) AS k FROM b a LEFT JOIN b b2 ON a.user_id = b2.user_id AND b2.us >= a.us + 21600000000),
 l AS (SELECT user_id, max(us) AS last FROM b GROUP BY user_id),
 z AS (SELECT j.event_id, j.us, coalesce(j.t, CASE WHEN l.last > j.us THEN l.last END) AS t FROM j JOIN b USING (event_id) JOIN l ON l.user_id = b.user_id WHERE k = 1)
 SELECT event_id, CASE WHEN t - us <= 86400000000 THEN t END AS later_us FROM z""")
def lookahead_or_last(spark, sf):
    """Each event with the first one six hours later or else the last, within a day. [JOI-07]"""
    out = timejoins.later_sample(events(spark, sf), ["user_id"], "us", "event_id", "v", 6 * HOUR, True, 24 * HOUR)
    return out.select("event_id", F.col("later.t").alias("later_us"))


@query(""", p AS (SELECT user_id, us, max(v) AS v FROM b WHERE kind = 'purchase' GROUP BY ALL),
 c AS (SELECT event_id, user_id, us FROM b WHERE kind = 'click'),
 j AS (SELECT c.event_id, c.us AS cu, p.us, p.v, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(p.us - c.us), p.us) AS k FROM c LEFT JOIN p ON c.user_id = p.user_id AND abs(p.us - c.us) <= 43200000000)
 SELECT event_id, us AS found_us, v AS found_v FROM j WHERE k = 1""")
def asof_nearest_tolerance(spark, sf):
    """Each click with the user's nearest purchase within twelve hours. [JOI-08, JOI-09, JOI-10]"""
    e = events(spark, sf)
    out = timejoins.as_of(e.where("kind = 'click'").select("event_id", "user_id", "us"), e.where("kind = 'purchase'"), ["user_id"], "us", "v", "nearest", 12 * HOUR)
    return out.select("event_id", F.col("found.t").alias("found_us"), F.col("found.v").alias("found_v"))


@query(" SELECT event_id FROM b a WHERE kind = 'error' AND EXISTS (SELECT 1 FROM b x WHERE x.kind = 'purchase' AND x.user_id = a.user_id AND x.us BETWEEN a.us - 3600000000 AND a.us + 54000000000)")
def interval_semi(spark, sf):
    """Errors with a purchase of the user from an hour before to 15 hours after. [JOI-11]"""
    e = events(spark, sf)
    return timejoins.interval_semi(e.where("kind = 'error'"), e.where("kind = 'purchase'"), ["user_id"], (F.col("us") - HOUR, F.col("us") + 15 * HOUR), "us").select("event_id")


@query(" SELECT event_id FROM b a WHERE kind = 'view' AND NOT EXISTS (SELECT 1 FROM b x WHERE x.kind = 'signup' AND x.user_id = a.user_id AND abs(x.us - a.us) < 86400000000)")
def tolerance_anti(spark, sf):
    """Views without a signup of the user less than a day away. [JOI-12]"""
    e = events(spark, sf)
    return timejoins.interval_semi(e.where("kind = 'view'"), e.where("kind = 'signup'"), ["user_id"], (F.col("us") - 24 * HOUR + 1, F.col("us") + 24 * HOUR - 1), "us", anti=True).select("event_id")


@query(""", i AS (SELECT event_id, user_id, kind, us AS t0, us + v * 60000000 AS t1 FROM b)
 SELECT event_id FROM i a WHERE kind = 'click' AND NOT EXISTS (SELECT 1 FROM i x WHERE x.kind = 'purchase' AND x.user_id = a.user_id AND least(a.t1, x.t1) - greatest(a.t0, x.t0) > 300000000)""")
def overlap_anti(spark, sf):
    """Click intervals that overlap no purchase interval by more than five minutes. [JOI-13]"""
    i = events(spark, sf).select("event_id", "user_id", "kind", F.col("us").alias("t0"), (F.col("us") + F.col("v") * 60_000_000).alias("t1"))
    return timejoins.overlap_anti(i.where("kind = 'click'"), i.where("kind = 'purchase'"), ["user_id"], "t0", "t1", 300_000_000, 48 * HOUR).select("event_id")


@query(""", i AS (SELECT event_id, user_id, kind, us AS t0, us + v * 60000000 AS t1 FROM b),
 j AS (SELECT a.event_id, x.event_id AS o, row_number() OVER (PARTITION BY a.event_id ORDER BY x.t1 DESC, x.event_id) AS k FROM i a LEFT JOIN i x ON x.kind = 'purchase' AND x.user_id = a.user_id AND x.t0 <= a.t0 + 3600000000 AND x.t1 >= a.t0 - 7200000000 WHERE a.kind = 'click')
 SELECT event_id, o AS last_owner FROM j WHERE k = 1""")
def last_possessor(spark, sf):
    """For each click the purchase interval around it that ends last. [JOI-14]"""
    i = events(spark, sf).select("event_id", "user_id", "kind", F.col("us").alias("t0"), (F.col("us") + F.col("v") * 60_000_000).alias("t1"))
    r = i.where("kind = 'purchase'").select("user_id", "t0", "t1", F.col("event_id").alias("owner"))
    return timejoins.last_overlapping(i.where("kind = 'click'"), r, ["user_id"], (F.col("t0") - 2 * HOUR, F.col("t0") + HOUR), "t0", "t1", "owner", 48 * HOUR).select("event_id", "last_owner")


@query(""", d AS (SELECT day, user_id, v FROM b WHERE kind = 'click'), q AS (SELECT day, max(v) AS ball FROM b WHERE kind = 'purchase' GROUP BY day)
 SELECT day, arg_min(user_id, abs(v - ball) * 100000 + user_id) AS user_id, min(abs(v - ball)) AS distance FROM d JOIN q USING (day) WHERE abs(v - ball) <= 20000 GROUP BY day""")
def nearest_neighbour_per_group(spark, sf):
    """Per day the user whose click is nearest to the largest purchase. [JOI-05]"""
    e = events(spark, sf)
    q = e.where("kind = 'purchase'").groupBy("day").agg(F.max("v").alias("ball"))
    d = e.where("kind = 'click'").select("day", "user_id", "v")
    return timejoins.nearest(q, d, ["day"], F.abs(F.col("v") - F.col("ball")), "user_id", 20_000).select("day", "user_id", "distance")


@query("""WITH c AS (SELECT least((CAST(l_quantity AS BIGINT) * 21) // 50, 20) AS bx, least((CAST(round(l_discount * 100) AS BIGINT) * 14) // 10, 13) AS "by" FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 AND round(l_discount * 100) BETWEEN 0 AND 10)
 SELECT CAST("by" AS INTEGER) AS "by", CAST(bx AS INTEGER) AS bx, count(*) AS weight FROM c GROUP BY ALL""", events=False)
def heatmap_2d(spark, sf):
    """Quantity by discount in 21 by 14 cells. [AGG-04]"""
    li = table(spark, sf, "lineitem")
    return choose.histogram_2d(li, [], F.col("l_quantity").cast("long"), F.round(F.col("l_discount") * 100).cast("long"), F.lit(1), 50, 10, 21, 14)


@query("""SELECT o_orderkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER w AS score_f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) OVER w AS score_o
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""", events=False)
def running_score(spark, sf):
    """Running counts of two outcomes of each customer. [AGG-19]"""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", *[F.sum(F.when(F.col("o_orderstatus") == k, 1).otherwise(0)).over(w).alias(f"score_{k.lower()}") for k in "FO"])


@query(""", k AS (SELECT user_id, kind, sum(v) AS weight FROM b GROUP BY ALL), t AS (SELECT *, sum(weight) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, kind) AS r FROM k)
 SELECT user_id, kind, CAST(weight AS BIGINT) AS weight, CAST(total AS BIGINT) AS total FROM t WHERE r = 1""")
def vote_winner_share(spark, sf):
    """Each user's kind with the largest summed value. [AGG-16]"""
    return choose.votes(events(spark, sf), ["user_id"], "kind", "v")


@query(""" SELECT user_id, us, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS k FROM b) WHERE k = 1""")
def upsert_latest(spark, sf):
    """The latest version of each key. [SNK-04]"""
    return choose.latest(events(spark, sf), ["user_id"], ["us", "event_id"]).select("user_id", "us", "event_id")


@query(""", base AS (SELECT event_id AS k, v FROM b WHERE event_id % 3 <> 0), m AS (SELECT event_id AS k, CASE WHEN event_id % 7 = 0 THEN NULL ELSE -v END AS v FROM b WHERE event_id % 5 = 0),
 j AS (SELECT coalesce(base.k, m.k) AS k, CASE WHEN m.k IS NOT NULL THEN m.v ELSE base.v END AS v, m.k IS NOT NULL AS by_hand FROM base FULL JOIN m ON base.k = m.k) SELECT k, v, by_hand FROM j WHERE v IS NOT NULL""")
def manual_override(spark, sf):
    """Detected rows with manual ones in their place; a manual null deletes. [SET-01]"""
    e = events(spark, sf)
    base = e.where("event_id % 3 <> 0").select(F.col("event_id").alias("k"), "v")
    hand = e.where("event_id % 5 = 0").select(F.col("event_id").alias("k"), F.when(F.col("event_id") % 7 != 0, -F.col("v")).alias("v"))
    return choose.overridden(base, hand, ["k"], "v")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", events=False)
def json_extract_scores(spark, sf):
    """A number from a JSON column. [SFN-34, SRC-06]"""
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n_done FROM customer""", events=False)
def scalar_subquery_counts(spark, sf):
    """Counts from correlated scalar subqueries. [AGG-20, AGG-23]"""
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done"))
    return table(spark, sf, "customer").select("c_custkey").join(n, "c_custkey", "left").fillna(0, ["n_orders", "n_done"])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')", events=False)
def not_exists_anti(spark, sf):
    """Customers without an urgent order. [JOI-16]"""
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("""SELECT n_name, coalesce(sum(CASE WHEN c_acctbal > 0 THEN 1 END), 0) AS solvent, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'MACHINERY' GROUP BY n_name""", events=False)
def left_join_coalesce(spark, sf):
    """Counts over a left join with defaults. [AGG-18, JOI-22]"""
    c = table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count_if(F.col("c_acctbal") > 0).alias("solvent"), F.count("*").alias("customers"))
    return table(spark, sf, "nation").join(F.broadcast(c), "n_nationkey", "left").select("n_name", F.coalesce("solvent", F.lit(0)).alias("solvent"), F.coalesce("customers", F.lit(0)).alias("customers"))


@query("""WITH x AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_returnflag FROM lineitem),
 r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY cents DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber) AS rank FROM x) SELECT * FROM r WHERE rank <= 5""", events=False)
def multi_key_stable_topk(spark, sf):
    """The five dearest lines of each flag under a full order. [TOP-01, TOP-03]"""
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), "l_returnflag")
    return choose.top_k(x, ["l_returnflag"], [F.desc("cents"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], 5)


@query("SELECT c_custkey, n_nationkey FROM customer JOIN nation ON lower(trim('  ' || upper(n_name))) = lower('nation_' || c_nationkey)", events=False)
def normalised_name_join(spark, sf):
    """A join on trimmed, case-folded names. [JOI-21]"""
    n = table(spark, sf, "nation").select("n_nationkey", F.lower(F.trim(F.concat(F.lit("  "), F.upper("n_name")))).alias("k"))
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("nation_"), F.col("c_nationkey")).alias("k"))
    return c.join(n, "k").select("c_custkey", "n_nationkey")


@query(" SELECT event_id, (us // 10000000 + user_id) % 7 = 3 AS held_out FROM b")
def holdout_split(spark, sf):
    """A hold-out split by ten-second slots. [FLT-13]"""
    return events(spark, sf).select("event_id", (F.pmod(F.expr("us div 10000000") + F.col("user_id"), F.lit(7)) == 3).alias("held_out"))


@query(""", g AS (SELECT kind, us // 3600000000 AS h, event_id, v FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY kind, user_id % 10 ORDER BY v DESC, event_id) AS k FROM b) SELECT kind, user_id % 10 AS part, event_id FROM r WHERE k <= 3""")
def hard_example_caps(spark, sf):
    """The hardest rows of each class. [TOP-10]"""
    e = events(spark, sf).withColumn("part", F.col("user_id") % 10)
    return choose.top_k(e, ["kind", "part"], [F.desc("v"), "event_id"], 3).select("kind", "part", "event_id")


@query()
def greedy_nms(spark, sf):
    """The strongest events of each kind at least a day apart. [TOP-05]"""
    return choose.suppressed(events(spark, sf).where("v > 5000"), ["user_id", "kind"], "us", "v", "event_id", 24 * HOUR)


@query("""WITH u AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding) AS x FROM embeddings), q AS (SELECT label, pos, CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT) AS x FROM u)
 SELECT label, CAST(pos - 1 AS INTEGER) AS pos, CAST(sum(x) AS BIGINT) AS total, count(*) AS n FROM q GROUP BY ALL""", events=False)
def vector_sums(spark, sf):
    """Element sums of each label's vectors, in millionths. [AGG-25, AGG-26]"""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("label", "pos").agg(F.sum(F.round(F.col("x").cast("double") * 1_000_000).cast("long")).alias("total"), F.count("*").alias("n"))


@query()
def weighted_mean_vector(spark, sf):
    """Weighted mean vector of each label with three rows or more. [AGG-25, AGG-26]"""
    return vectors.weighted_mean(table(spark, sf, "embeddings"), ["label"], "embedding", F.least(F.col("vec_id") + 1, F.lit(200)), 3)


@query()
def cosine_top1_margin(spark, sf):
    """Each vector with the label whose mean is most similar, if it leads clearly. [SFN-16, TOP-04, STA-05]"""
    e = table(spark, sf, "embeddings")
    means = vectors.weighted_mean(e, ["label"], "embedding", F.lit(1.0)).select(F.col("label").alias("guess"), "mean")
    pairs = e.select("vec_id", "label", "embedding").join(F.broadcast(means))
    scored = pairs.select("vec_id", "label", "guess", vectors.cosine(F.col("embedding"), F.col("mean")).alias("score"))
    return choose.top_with_margin(scored, ["vec_id"], "score", "guess", 0.35, 0.02)


@query()
def weighted_centroid(spark, sf):
    """Inverse-variance weighted centroid of each user's events. [AGG-24]"""
    e = events(spark, sf).withColumn("x", (F.col("us") % 1000).cast("double")).withColumn("y", F.col("v").cast("double"))
    return vectors.weighted_centroid(e, ["user_id"], ["x", "y"], F.greatest(F.col("y"), F.lit(1.0)))


@query("""WITH x AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_suppkey AS x1, l_linenumber * 10 AS y1, l_suppkey + CAST(l_quantity AS BIGINT) AS x2, l_linenumber * 10 + 40 AS y2 FROM lineitem),
 a AS (SELECT *, greatest(least(x2, 60) - greatest(x1, 20), 0) * greatest(least(y2, 70) - greatest(y1, 10), 0) AS inter FROM x)
 SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, inter, (x2 - x1) * (y2 - y1) + 40 * 60 - inter AS whole FROM a""", events=False)
def box_overlap(spark, sf):
    """Intersection and union area with a fixed box. [SFN-05]"""
    x1, y1 = F.col("l_suppkey"), (F.col("l_linenumber") * 10).cast("long")
    both, whole = geometry.overlap([x1, y1, x1 + F.col("l_quantity").cast("long"), y1 + 40], [F.lit(20), F.lit(10), F.lit(60), F.lit(70)])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", both.alias("inter"), whole.alias("whole"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""", events=False)
def status_cube(spark, sf):
    """A cube with grouping levels. [§2.16]"""
    o = table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority")
    return o.agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


@query("""SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'""", events=False)
def set_algebra(spark, sf):
    """Intersection and difference of key sets. [SET-03, §2.16]"""
    o = table(spark, sf, "orders")
    k = lambda c: o.where(c).select("o_custkey")
    return k("o_orderstatus = 'F'").intersect(k("o_orderstatus = 'O'")).exceptAll(k("o_orderpriority = '1-URGENT'").distinct())


@query(" SELECT kind, user_id, us, 'event' AS source FROM b WHERE v > 20000 UNION ALL SELECT kind, user_id, us + 1 AS us, 'moment' FROM b WHERE v < 20")
def unified_timeline(spark, sf):
    """Several kinds of events in one timeline. [SET-02, SET-07]"""
    e = events(spark, sf)
    a = e.where("v > 20000").select("kind", "user_id", "us", F.lit("event").alias("source"))
    b = e.where("v < 20").select("kind", "user_id", (F.col("us") + 1).alias("us"), F.lit("moment").alias("source"))
    return a.unionByName(b)


@query("""SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS w0, event_type AS kind, count(*) AS n FROM events GROUP BY ALL""", events=False)
def tumbling_windows(spark, sf):
    """Six-hour tumbling windows. [STR-08]"""
    e = events(spark, sf)
    return e.groupBy((F.expr(f"us div {6 * HOUR}") * (6 * HOUR)).alias("w0"), "kind").agg(F.count("*").alias("n"))


@query(""", s AS (SELECT count(*) FILTER (WHERE kind = 'click') AS click, count(*) FILTER (WHERE kind = 'view') AS view, user_id FROM b GROUP BY user_id) SELECT * FROM s""")
def kind_pivot(spark, sf):
    """Counts by kind as columns. [§2.16]"""
    return events(spark, sf).groupBy("user_id").pivot("kind", ["click", "view"]).agg(F.count(F.lit(1))).fillna(0)
