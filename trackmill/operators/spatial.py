"""Joins by distance on the globe, over a grid whose cells are as large as the reach."""

from __future__ import annotations

from math import ceil, cos, degrees, log, pi, radians

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.functions.geometry import EARTH_M, wrapped
from trackmill.sources.stored import stored


def apart_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a small part of the globe, across the date line too."""
    east = F.radians(wrapped(lon2 - lon1)) * EARTH_M * F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot(east, F.radians(lat2 - lat1) * EARTH_M)


def _columns(band: Column, high: float) -> Column:
    """How many cells go round the globe in a band: none is narrower than the reach where the band, and the ones beside it, are narrowest."""
    polar = F.least(F.lit(90.0), F.greatest(F.abs(band - 1), F.abs(band + 2)) * high)
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(polar)) / high).cast("long"))


def within(left: DataFrame, right: DataFrame, reach_m: float, left_id: str, right_id: str, at: tuple[str, str] = ("lat", "lon"), most: int = 1000) -> DataFrame:
    """Pairs (left_id, right_id, metres) of places at most reach_m apart. Rows without a place have none. [JOI-17]

    Cells are as high as the reach and, in each band of latitude, at least as wide; a right row is in its own and the eight cells around, so a pair meets
    once, in the left row's cell. Cells with a thousandth of the left rows or more (at most a thousand of them, broadcast) are split:
    their left rows are dealt over parts, and their right rows are in each part.
    """
    high = degrees(reach_m / EARTH_M) * (1 + 1e-9)
    if high * 3 > 180:
        raise ValueError("the reach must be small against the globe")
    lat, lon = (F.col(c).cast("double") for c in at)
    place = [lat.alias("lat"), wrapped(lon).alias("lon")]
    lone = left.select(F.col(left_id).alias("l"), *place).where("lat is not null and lon is not null").withColumn("band", F.floor(F.col("lat") / high))
    column = lambda n: F.least(F.floor((F.col("lon") + 180) / 360 * n).cast("long"), n - 1)
    lone = lone.withColumn("cell", column(_columns(F.col("band"), high)))
    known = right.select(F.col(right_id).alias("r"), *[c.alias(f"r{n}") for c, n in zip((lat, wrapped(lon)), ("lat", "lon"), strict=True)]).where("rlat is not null and rlon is not null")
    known = known.withColumn("band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("rlat") / high) + k)))
    n = _columns(F.col("band"), high)
    here = F.least(F.floor((F.col("rlon") + 180) / 360 * n).cast("long"), n - 1)
    known = known.withColumn("cell", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.pmod(here + k, n)))))
    counts = lone.groupBy("band", "cell").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    hot = counts.join(F.broadcast(total)).where(F.col("n") * most >= F.col("total")).select("band", "cell", F.ceil(F.col("n") * most / F.col("total")).cast("int").alias("parts"))  # one row
    parts = F.coalesce("parts", F.lit(1))
    lone = lone.join(F.broadcast(hot), ["band", "cell"], "left").withColumn("part", F.pmod(F.xxhash64("l", "lat", "lon"), parts).cast("int")).drop("parts")
    known = known.join(F.broadcast(hot), ["band", "cell"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    both = lone.join(known, ["band", "cell", "part"]).withColumn("metres", apart_m(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon")))
    return both.where(F.col("metres") <= reach_m).select(F.col("l").alias(left_id), F.col("r").alias(right_id if right_id != left_id else f"{right_id}_near"), "metres")


#: Metres by which a smaller reach is widened, so that what is equally far in whole micrometres is met together.
SLACK_M = 2e-6


def nearest_within(left: DataFrame, right: DataFrame, reach_m: float, left_id: str, right_id: str, at: tuple[str, str] = ("lat", "lon"), digits: int | None = None, most: int = 1000) -> DataFrame:
    """For each left row with one, the nearest right row at most reach_m away; of equal ones, or of those equal in `digits` (6 or more) decimals of a metre, the smallest. [JOI-17]

    Equal places are looked up once, and near ones first: a place that has one within a quarter of a quarter .. of the reach is done, the others go on with
    four times as much. The first reach is such that its fullest cells hold about sixteen places, so pairs grow with the places rather than with their square.
    Tables between are written; places with a thousandth of the left rows are joined by broadcast.
    """
    lat, lon = (F.col(c).cast("double") for c in at)
    place = F.struct(lat.alias("lat"), wrapped(lon).alias("lon")).alias("place")
    given = lambda df, name: df.select(F.col(name), place).where("place.lat is not null and place.lon is not null")
    other = right_id if right_id != left_id else f"{right_id}_near"
    asked = stored(given(left, left_id), "asked")
    known = stored(given(right, right_id).groupBy("place").agg(F.min(right_id).alias(other)).select(other, "place.*"), "known")
    high = degrees(reach_m / EARTH_M)
    band = F.floor(F.col("lat") / high)
    cells = known.groupBy(band.alias("band"), F.floor((F.col("lon") + 180) / 360 * _columns(band, high)).alias("cell"))
    fullest = cells.count().agg(F.max("count")).first()[0] or 1
    steps = max(0, ceil(log(fullest / 16, 16)))
    counts = stored(asked.groupBy("place").agg(F.count("*").alias("n")), "places")
    todo, answers = counts.select("place", "place.*"), None
    for k in range(steps, -1, -1):
        near = reach_m / 4**k
        pairs = within(todo, known, near + SLACK_M if k else reach_m, "place", other)
        best = pairs.groupBy("place").agg(F.min(F.struct(rounded(digits).alias("rounded"), other, "metres")).alias("m"))
        found = stored(best.where(F.col("m.metres") <= near) if k else best, "nearest")
        answers = found if answers is None else answers.unionByName(found)
        if k:
            todo = stored(todo.join(found.select("place"), "place", "left_anti"), "places")
    answers = answers.join(counts, "place")
    hot = F.col("n") * most >= F.lit(asked.count())
    shown = asked.join(F.broadcast(answers.where(hot).select("place", "m")), "place")
    rest = asked.join(F.broadcast(answers.where(hot).select("place")), "place", "left_anti").join(answers.where(~hot).select("place", "m"), "place")
    return shown.unionByName(rest).groupBy(left_id).agg(F.min("m").alias("m")).select(left_id, f"m.{other}", "m.metres")


def rounded(digits: int | None) -> Column:
    return F.col("metres") if digits is None else F.round("metres", digits)


#: What a degree of latitude is, for tests and callers that build grids.
METRES_A_DEGREE = pi * EARTH_M / 180


def width_at(lat: float) -> float:
    """Metres of a degree of longitude."""
    return METRES_A_DEGREE * cos(radians(lat))
