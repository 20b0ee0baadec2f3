"""Queries that show the remaining operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackmill.functions import geometry, parsing, vectors
from trackmill.operators import choose, grouped, sequences
from trackmill.plans.registry import events, query, table


@query("""WITH x AS (SELECT p_partkey, p_size % 3 = 0 AS flip, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size % 3 = 0 END AS f, p_size % 2 + 1 AS period, CAST(p_partkey % 105 AS BIGINT) AS x FROM part)
 SELECT p_partkey, CASE WHEN coalesce(f, period = 2, false) THEN 105 - x ELSE x END AS x FROM x""", events=False)
def mirrored_positions(spark, sf):
    """Positions of the second half in the first one's direction. [PRJ-02, FLT-15]"""
    p = table(spark, sf, "part")
    flip = F.when(F.col("p_size") % 4 != 0, F.col("p_size") % 3 == 0)
    return p.select("p_partkey", geometry.mirrored(flip, F.col("p_size") % 2 + 1, F.col("p_partkey") % 105, 105).cast("long").alias("x"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'c' || c_nationkey || 't' || c_custkey ELSE 'p' || c_nationkey END AS entity FROM customer""", events=False)
def entity_keys(spark, sf):
    """Entity keys: the linked player, else the clip's track. [PRJ-04]"""
    c = table(spark, sf, "customer")
    player = F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey"))
    return c.select("c_custkey", F.coalesce(F.concat(F.lit("p"), player.cast("string")), F.concat(F.lit("c"), F.col("c_nationkey"), F.lit("t"), F.col("c_custkey"))).alias("entity"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE p_size % 3 END AS team FROM part""", events=False)
def swapped_teams(spark, sf):
    """Two codes exchanged. [PRJ-05]"""
    t = F.col("p_size") % 3
    return table(spark, sf, "part").select("p_partkey", F.when(t == 0, 1).when(t == 1, 0).otherwise(t).alias("team"))


@query("""SELECT c_custkey, coalesce(TRY_CAST(regexp_extract(right(c_name, 3) || 'a', '^\\s*(\\d+)', 1) AS INTEGER), 0) AS number FROM customer""", events=False)
def leading_numbers(spark, sf):
    """The number a text begins with. [TOP-11]"""
    return table(spark, sf, "customer").select("c_custkey", parsing.leading_number(F.concat(F.substring("c_name", -3, 3), F.lit("a"))).alias("number"))


@query("""SELECT p_partkey, coalesce(nullif(left(trim(regexp_replace(CASE p_partkey % 4 WHEN 0 THEN '_é ' || p_name || '!' WHEN 1 THEN '/' ELSE p_name || ' / ' || p_brand END, '[^\\p{L}\\p{N}_-]+', '_', 'g'), '_'), 60), ''), 'clip') AS name FROM part""", events=False)
def safe_names(spark, sf):
    """Texts as file names. [SFN-22]"""
    k = F.col("p_partkey") % 4
    named = F.when(k == 0, F.concat(F.lit("_é "), "p_name", F.lit("!"))).when(k == 1, "/").otherwise(F.concat("p_name", F.lit(" / "), "p_brand"))
    return table(spark, sf, "part").select("p_partkey", parsing.safe_name(named).alias("name"))


@query(""" SELECT event_id, CAST(v // 60 AS VARCHAR) || ':' || lpad(CAST(v % 60 AS VARCHAR), 2, '0') AS clock FROM b""")
def clock_texts(spark, sf):
    """Minutes and seconds as text. [SFN-21]"""
    return events(spark, sf).select("event_id", parsing.clock(F.col("v")).alias("clock"))


@query(""", r AS (SELECT user_id, ('0x' || substr(hex(user_id * 9973 % 16777216), 1))::VARCHAR AS h, user_id * 9973 % 16777216 AS c, count(*) AS w FROM b GROUP BY user_id),
 s AS (SELECT user_id % 2 AS team, sum((c // 65536) * w) AS r, sum((c // 256 % 256) * w) AS g, sum((c % 256) * w) AS bl, sum(w) AS w FROM r GROUP BY 1)
 SELECT team, CAST(r // w AS BIGINT) AS r, CAST(g // w AS BIGINT) AS g, CAST(bl // w AS BIGINT) AS b FROM s""")
def team_colours(spark, sf):
    """Weighted mean colour of each group. [§2.16]"""
    t = events(spark, sf).groupBy("user_id").agg(F.count("*").alias("w")).withColumn("hex", F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("user_id") * 9973 % 16777216)), 6, "0")))
    parts = parsing.rgb(F.col("hex"))
    s = t.groupBy((F.col("user_id") % 2).alias("team")).agg(*[F.sum(p.cast("long") * F.col("w")).alias(c) for p, c in zip(parts, "rgb", strict=True)], F.sum("w").alias("w"))
    return s.select("team", *[F.expr(f"{c} div w").alias(c) for c in "rgb"])


@query(""", g AS (SELECT user_id, day, count(*) AS n FROM b GROUP BY ALL) SELECT user_id, count(*) AS days, count(*) FILTER (WHERE n >= 3) AS busy, CAST(sum(n) AS BIGINT) AS total, quantile_cont(n, 0.5) AS median FROM g GROUP BY user_id""")
def activity_summary(spark, sf):
    """Counts, conditional counts and medians in two levels. [§2.16]"""
    g = events(spark, sf).groupBy("user_id", "day").agg(F.count("*").alias("n"))
    return g.groupBy("user_id").agg(F.count("*").alias("days"), F.count_if(F.col("n") >= 3).alias("busy"), F.sum("n").alias("total"), F.percentile("n", 0.5).alias("median"))


@query(""", t AS (SELECT user_id, us, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS nu, v, lead(v) OVER (PARTITION BY user_id ORDER BY us, event_id) AS nv FROM b)
 SELECT user_id, count(*) FILTER (WHERE abs(nv - v) * 3600000000 < 100 * (nu - us)) AS still, count(nu) AS steps FROM t GROUP BY user_id HAVING count(nu) >= 3""")
def stillness(spark, sf):
    """Steps slower than a limit among all of a series. [WIN-03]"""
    d = sequences.steps(events(spark, sf), ["user_id"], ["us", "event_id"], "us", ["v"])
    return d.groupBy("user_id").agg(F.count_if(F.abs("d_v") * 3_600_000_000 < 100 * F.col("dt")).alias("still"), F.count("dt").alias("steps")).where("steps >= 3")


@query(""" SELECT DISTINCT kind, user_id % 5 AS part FROM b EXCEPT SELECT 'view', 3""")
def set_difference(spark, sf):
    """Distinct keys less some. [SET-03, SET-04, SET-06]"""
    e = events(spark, sf).select("kind", (F.col("user_id") % 5).alias("part")).distinct()
    return e.where(~((F.col("kind") == "view") & (F.col("part") == 3)))


@query(""", k AS (SELECT user_id, kind, v, event_id, row_number() OVER (PARTITION BY user_id, kind ORDER BY v, event_id) AS r FROM b) SELECT user_id, kind, v, event_id FROM k WHERE r = 1""")
def best_per_key(spark, sf):
    """The cheapest row of each key. [SET-05]"""
    return choose.top_k(events(spark, sf), ["user_id", "kind"], ["v", "event_id"], 1).select("user_id", "kind", "v", "event_id")


@query(""" SELECT user_id, kind, count(*) AS n, rank() OVER (PARTITION BY kind ORDER BY count(*) DESC) AS rank, dense_rank() OVER (PARTITION BY kind ORDER BY count(*) DESC) AS dense FROM b GROUP BY user_id, kind""")
def ranked_entities(spark, sf):
    """Ranks with ties. [§2.16]"""
    w = Window.partitionBy("kind").orderBy(F.desc("n"))
    n = events(spark, sf).groupBy("user_id", "kind").agg(F.count("*").alias("n"))
    return n.select("user_id", "kind", "n", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense"))


@query()
def kmeans_partition(spark, sf):
    """Vectors in five clusters. [STA-01]"""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return KMeans(k=5, seed=1, maxIter=20).fit(e).transform(e).select("vec_id", "label", "prediction")


@query()
def stitched_chains(spark, sf):
    """Intervals of one kind linked to the next within a day, in order of cost. [TOP-07]"""
    r = sequences.runs(events(spark, sf), ["user_id"], "us", "event_id", "kind", least=2)
    nxt = r.select("user_id", "kind", F.col("t0").alias("n0"), F.col("tie").alias("b"))
    day = 86_400_000_000
    pairs = sequences_pairs(r, nxt, day)
    return grouped.chains(pairs, ["user_id"], "a", "b", "cost")


def sequences_pairs(runs, following, reach):
    """Candidate pairs by an equality on user, kind and time bucket, then the gap."""
    left = runs.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("t1") / reach), F.floor(F.col("t1") / reach) + 1)))
    right = following.withColumn("bucket", F.floor(F.col("n0") / reach))
    both = left.join(right, ["user_id", "kind", "bucket"]).where((F.col("n0") > F.col("t1")) & (F.col("n0") - F.col("t1") <= reach))
    return both.select("user_id", F.col("tie").alias("a"), "b", (F.col("n0") - F.col("t1")).cast("double").alias("cost"))


@query()
def station_groups(spark, sf):
    """Events of each kind and day grouped by place, one after the other. [STA-07]"""
    e = events(spark, sf).select("kind", "day", "event_id", (F.col("v") % 500).cast("double").alias("east"), (F.col("user_id") % 90).cast("double").alias("north"), F.lit(5.0).alias("acc"), (F.col("us") / 1e6).alias("t"))
    return grouped.stations(e, ["kind", "day"], "east", "north", "acc", "t", tie="event_id").select("event_id", "station")


@query()
def similar_pairs(spark, sf):
    """Each vector's similarity to its label's mean. [SFN-16]"""
    e = table(spark, sf, "embeddings")
    m = vectors.weighted_mean(e, ["label"], "embedding", F.lit(1.0))
    return e.join(m, "label").select("vec_id", vectors.cosine(F.col("embedding"), F.col("mean")).alias("similarity"))


@query()
def sketched_counts(spark, sf):
    """Approximate distinct counts and quantiles. [§2.16]"""
    return events(spark, sf).groupBy("kind").agg(F.approx_count_distinct("user_id").alias("users"), F.percentile_approx("v", 0.5).alias("median"))
