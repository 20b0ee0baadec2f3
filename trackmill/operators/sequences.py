"""Gaps-and-islands, sessions, smoothing and repair of time-ordered series.

Every operator takes the partition keys of a series and an ordering whose last key is unique, so
that results don't depend on partitioning; consecutive operators on one series share an exchange and a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = list[str]


def _w(keys: Keys, order: Keys):
    return Window.partitionBy(*keys).orderBy(*order)


def islands(df: DataFrame, keys: Keys, order: Keys, starts: Column, name: str = "island") -> DataFrame:
    """Number the islands of a series; `starts` says whether a row begins a new one (the first row always does)."""
    w = _w(keys, order)
    return df.withColumn(name, F.sum(F.when(F.row_number().over(w) == 1, 1).when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def segments(df: DataFrame, keys: Keys, time: str, tie: str, max_gap: int, least: int = 2) -> DataFrame:
    """Cut a series where the step in time exceeds max_gap; segments of fewer than `least` rows go. [WIN-01]"""
    gap = F.col(time) - F.lag(time).over(_w(keys, [time, tie]))
    cut = islands(df, keys, [time, tie], gap > max_gap, "segment")
    n = F.count("*").over(Window.partitionBy(*keys, "segment"))
    return cut.withColumn("segment_rows", n).where(F.col("segment_rows") >= least)


def smoothed(df: DataFrame, keys: Keys, order: Keys, value: str, width: int = 5, name: str = "smooth") -> DataFrame:
    """Moving sum and divisor over min(width, rows) rows with the end values repeated beyond the ends. [WIN-02]

    An even width leans backwards. The sum is kept apart from its divisor so that integers stay exact.
    """
    w, whole = _w(keys, order), Window.partitionBy(*keys)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    n = F.least(F.lit(width), F.count("*").over(whole))
    back, ahead = F.floor(n / 2), n - 1 - F.floor(n / 2)
    total = F.lit(0)
    for k in range(-(width // 2), width - width // 2):
        at = F.coalesce(F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w), first if k < 0 else last)
        total = total + F.when((F.lit(k) >= -back) & (F.lit(k) <= ahead), at).otherwise(0)
    return df.withColumn(f"{name}_sum", total).withColumn(f"{name}_n", n)


def steps(df: DataFrame, keys: Keys, order: Keys, time: str, values: Keys) -> DataFrame:
    """Differences to the row before: dt and d_<value>. [WIN-03]"""
    w = _w(keys, order)
    out = df.withColumn("dt", F.col(time) - F.lag(time).over(w))
    for v in values:
        out = out.withColumn(f"d_{v}", F.col(v) - F.lag(v).over(w))
    return out


def fast_runs(df: DataFrame, keys: Keys, order: Keys, time: str, fast: Column, least: int, value: str | None = None) -> DataFrame:
    """Runs of fast steps: from the sample before the first to the last one, lasting at least `least`; with the largest `value` as top. [WIN-04]"""
    w = _w(keys, order)
    marked = df.withColumn("__fast", F.coalesce(fast, F.lit(False))).withColumn("__before", F.lag(time).over(w))
    marked = islands(marked, keys, order, F.col("__fast") != F.lag("__fast").over(w), "run")
    runs = marked.where("__fast").groupBy(*keys, "run").agg(F.min("__before").alias("t0"), F.max(time).alias("t1"), F.count("*").alias("steps"), *([F.max(value).alias("top")] if value else []))
    return runs.where(F.col("t1") - F.col("t0") >= least).drop("run")


def runs(df: DataFrame, keys: Keys, time: str, tie: str, owner: str, skip: int | None = None, least: int = 1, rank: str | None = None) -> DataFrame:
    """Runs of one owner in a row; a null owner ends a run, as does a step in `rank` of more than `skip`. [WIN-05]"""
    w = _w(keys, [time, tie])
    changed = ~F.col(owner).eqNullSafe(F.lag(owner).over(w))
    if skip is not None:
        changed = changed | (F.col(rank or time) - F.lag(rank or time).over(w) > skip)
    cut = islands(df, keys, [time, tie], changed, "run").where(F.col(owner).isNotNull())
    return cut.groupBy(*keys, owner, "run").agg(F.min(time).alias("t0"), F.max(time).alias("t1"), F.min(tie).alias("tie"), F.count("*").alias("n")).where(F.col("n") >= least).drop("run")


def merged(df: DataFrame, keys: Keys, owner: str, max_gap: int) -> DataFrame:
    """Join neighbouring runs of one owner that lie at most max_gap apart. [WIN-06]"""
    w = _w(keys, ["t0", "tie"])
    apart = (F.col(owner) != F.lag(owner).over(w)) | (F.col("t0") - F.lag("t1").over(w) > max_gap)
    return islands(df, keys, ["t0", "tie"], apart, "m").groupBy(*keys, owner, "m").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.min("tie").alias("tie"), F.sum("n").alias("n")).drop("m")


def passes(df: DataFrame, keys: Keys, owner: str, team: Column, max_gap: int, ends: bool = False) -> DataFrame:
    """From each run to the next, if the owner changes and at most max_gap lies between; ok within a team. ends: with t_end, where the next run begins. [WIN-07]"""
    w = _w(keys, ["t0", "tie"])
    nxt = df.withColumn("__team", team)
    nxt = nxt.withColumn("to_owner", F.lead(owner).over(w)).withColumn("__to_team", F.lead("__team").over(w)).withColumn("gap", F.lead("t0").over(w) - F.col("t1"))
    kept = nxt.where((F.col("to_owner") != F.col(owner)) & (F.col("gap") <= max_gap))
    return kept.select(*keys, F.col(owner).alias("from_owner"), "to_owner", F.col("__team").alias("team"), F.col("t1").alias("t"), "tie", (F.col("__team") == F.col("__to_team")).cast("int").alias("ok"), *([(F.col("t1") + F.col("gap")).alias("t_end")] if ends else []))


def despiked(df: DataFrame, keys: Keys, order: Keys, time: str, value: str, limit: int, max_dt: int) -> DataFrame:
    """Mark single outliers: both steps too fast, the direct step not, both within max_dt. [WIN-08]

    A sample after a dropped one compares with the one before that, so of a run of candidates every second stays.
    Speeds are compared by cross-multiplication: |dv| > limit * dt.
    """
    w = _w(keys, order)
    b = lambda c: F.lag(c).over(w)
    a = lambda c: F.lead(c).over(w)
    fast = lambda v0, v1, t0, t1: F.abs(v1 - v0) > limit * (t1 - t0)
    t, v = F.col(time), F.col(value)
    raw = fast(b(value), v, b(time), t) & fast(v, a(value), t, a(time)) & ~fast(b(value), a(value), b(time), a(time)) & (t - b(time) <= max_dt) & (a(time) - t <= max_dt)
    marked = df.withColumn("__raw", F.coalesce(raw, F.lit(False)))
    cut = islands(marked, keys, order, F.col("__raw") != F.lag("__raw").over(w), "__i")
    place = F.row_number().over(_w([*keys, "__i"], order))
    return cut.withColumn("spike", F.col("__raw") & (place % 2 == 1)).drop("__raw", "__i")


def filled(df: DataFrame, keys: Keys, grid: str, value: str, max_gap: int, max_step: int | None = None) -> DataFrame:
    """Add the missing grid places between neighbours at most max_gap apart, by linear interpolation (as numerator over divisor). [WIN-09, JOI-24]"""
    w = _w(keys, [grid])
    nxt = df.select(*keys, grid, value, F.lead(grid).over(w).alias("__g"), F.lead(value).over(w).alias("__v"))
    gap = F.col("__g") - F.col(grid)
    ok = (gap > 1) & (gap <= max_gap)
    if max_step is not None:
        ok = ok & (F.abs(F.col("__v") - F.col(value)) <= max_step * gap)
    new = nxt.where(ok).select(*keys, F.explode(F.sequence(F.col(grid) + 1, F.col("__g") - 1)).alias("__at"), grid, "__g", value, "__v")
    return new.select(*keys, F.col("__at").alias(grid), (F.col(value) * (F.col("__g") - F.col("__at")) + F.col("__v") * (F.col("__at") - F.col(grid))).alias("numerator"), (F.col("__g") - F.col(grid)).alias("divisor"))


def sessions(df: DataFrame, keys: Keys, time: str, tie: str, max_gap: int, same: str | None = None) -> DataFrame:
    """Candidates merged while they follow within max_gap (and agree in `same`): start, end, rows, first tie. [WIN-10]"""
    w = _w(keys, [time, tie])
    apart = F.col(time) - F.lag(time).over(w) > max_gap
    if same:
        apart = apart | (F.col(same) != F.lag(same).over(w))
    cut = islands(df, keys, [time, tie], apart, "session")
    return cut.groupBy(*keys, "session").agg(F.min(time).alias("t0"), F.max(time).alias("t1"), F.count("*").alias("n"), F.min_by(tie, F.struct(time, tie)).alias("head"))


def mask_groups(df: DataFrame, keys: Keys, place: str, mask: Column, bridge: int) -> DataFrame:
    """Groups of true places that lie at most `bridge` apart: first, last, rows. [WIN-12]"""
    held = df.where(mask)
    cut = islands(held, keys, [place], F.col(place) - F.lag(place).over(_w(keys, [place])) > bridge, "__group")
    return cut.groupBy(*keys, "__group").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).drop("__group")


def rolling_median(df: DataFrame, keys: Keys, order: Keys, value: str, reach: int = 15, name: str = "median") -> DataFrame:
    """Exact median over `reach` rows before and after. [WIN-13]"""
    return df.withColumn(name, F.percentile(value, 0.5).over(_w(keys, order).rowsBetween(-reach, reach)))


def largest_gap(df: DataFrame, keys: Keys, time: str, end: str, tie: str, least: int) -> DataFrame:
    """The largest pause of at least `least` between one row's end and the next one's start; of equal ones the first. [WIN-14]"""
    w = _w(keys, [time, tie])
    gaps = df.withColumn("gap", F.col(time) - F.lag(end).over(w)).where(F.col("gap") >= least)
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("gap"), time, tie))
    return gaps.withColumn("__k", best).where("__k = 1").drop("__k")


def ends(df: DataFrame, keys: Keys, time: str, tie: str, value: str, n: int = 5) -> DataFrame:
    """Per series: first and last time and the medians of the first and last n values. [WIN-18, AGG-12]"""
    up = F.row_number().over(_w(keys, [time, tie]))
    down = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(time), F.desc(tie)))
    k = df.withColumn("__u", up).withColumn("__d", down)
    return k.groupBy(*keys).agg(
        F.min(time).alias("t0"), F.max(time).alias("t1"), F.count("*").alias("n"),
        F.percentile(F.when(F.col("__u") <= n, F.col(value)), 0.5).alias("head_median"), F.percentile(F.when(F.col("__d") <= n, F.col(value)), 0.5).alias("tail_median"),
    )


def thinned(df: DataFrame, keys: Keys, order: Keys, n: int) -> DataFrame:
    """At most n rows at even distances, first and last among them. [FLT-12]"""
    w = _w(keys, order)
    k = df.withColumn("__k", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    step = F.col("__n") - 1
    # row k is taken if it is floor(i * (rows - 1) / (n - 1)) for some i
    i = F.floor((F.col("__k") * (n - 1) + step - 1) / F.greatest(step, F.lit(1)))
    taken = (F.col("__n") <= n) | (F.floor(i * step / (n - 1)) == F.col("__k"))
    return k.where(taken).drop("__k", "__n")


def coverage(df: DataFrame, keys: Keys, time: str, points: int, reach: int) -> DataFrame:
    """Share of `points` even grid times between a series' ends that lie within `reach` of a sample (as a count). [WIN-22]"""
    span = df.groupBy(*keys).agg(F.min(time).alias("a"), F.max(time).alias("b"))
    grid = span.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), (F.col("a") + F.floor((F.col("b") - F.col("a")) * F.col("i") / (points - 1))).cast("long").alias("g"))
    both = df.select(*keys, F.col(time).alias("g"), F.lit(0).alias("kind"), F.col(time).alias("s")).unionByName(grid.select(*keys, "g", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("s")))
    w = _w(keys, ["g", "kind"])
    back = F.last("s", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("s", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = both.withColumn("d", F.least(F.col("g") - back, ahead - F.col("g"))).where("kind = 1")
    return near.groupBy(*keys).agg(F.count_if(F.col("d") <= reach).alias("covered"), F.count("*").alias("points"))
