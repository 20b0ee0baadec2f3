"""Parsing and formatting of values that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso6709(text: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a position such as +52.0907+005.1214/; null out of range. [SFN-09]"""
    pattern = r"([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)"
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).try_cast("double")
    lat, lon = part(1), part(2)
    ok = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(ok, lat), F.when(ok, lon)


def epoch_seconds(text: Column) -> Column:
    """Seconds since the epoch of a time with a zone as Z, +01:00, +0100 or none (UTC). [SFN-10]"""
    iso = F.regexp_replace(F.regexp_replace(F.trim(text), r"([+-]\d{2})(\d{2})$", "$1:$2"), r"(?<=\d)$", "")
    zoned = F.when(iso.rlike(r"(Z|[+-]\d{2}:\d{2})$"), iso).otherwise(F.concat(iso, F.lit("Z")))
    return F.unix_micros(F.try_to_timestamp(F.regexp_replace(zoned, "T", " "))) / 1_000_000


def leading_number(text: Column) -> Column:
    """The digits a text begins with as a number, else 0: order of shirt numbers. [TOP-11]"""
    return F.coalesce(F.regexp_extract(text, r"^\s*(\d+)", 1).try_cast("int"), F.lit(0))


def safe_name(text: Column, most: int = 60) -> Column:
    """A text as a file name: letters and digits of any script, "_" and "-"; "clip" where nothing is left. [SFN-22]"""
    name = F.substring(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_-]+", "_"), r"^_+|_+$", ""), 1, most)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("clip"))


def clock(seconds: Column) -> Column:
    """Minutes and seconds, m:ss. [SFN-21]"""
    s = F.floor(seconds).cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def time_left(seconds: Column) -> Column:
    """How long something still takes, in words. [SFN-21]"""
    minutes = F.concat(F.lit("about "), F.rint(seconds / 60).cast("int"), F.lit(" min left"))
    return F.when(seconds < 90, "less than 2 min left").when(seconds < 3600, minutes).otherwise(F.format_string("about %.1f h left", seconds / 3600))


def match_minute(start_minute: Column, t: Column) -> Column:
    """The minute of a match at a time of its clip. [SFN-21]"""
    return F.concat(F.floor(F.coalesce(start_minute, F.lit(0)) + t / 60).cast("string"), F.lit("'"))


def rgb(hex_colour: Column) -> list[Column]:
    """The three parts of #rrggbb. [AGG-13]"""
    return [F.conv(F.substring(hex_colour, 2 + 2 * k, 2), 16, 10).cast("int") for k in range(3)]


def hex_colour(parts: list[Column]) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(p)), 2, "0") for p in parts])


def lab(parts: list[Column]) -> list[Column]:
    """CIE L*a*b* (D65) of sRGB parts 0..255. [SFN-15]"""
    lin = [F.when(p / 255 <= 0.04045, p / 255 / 12.92).otherwise(F.pow((p / 255 + 0.055) / 1.055, 2.4)) for p in parts]
    rows = ((0.4124, 0.3576, 0.1805, 0.95047), (0.2126, 0.7152, 0.0722, 1.0), (0.0193, 0.1192, 0.9505, 1.08883))
    t = [(lin[0] * r + lin[1] * g + lin[2] * b) / n for r, g, b, n in rows]
    f = [F.when(x > 216 / 24389, F.pow(x, F.lit(1 / 3))).otherwise((24389 / 27 * x + 16) / 116) for x in t]
    return [116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])]
