"""Keyframes as they are stored: clicks and scores as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLICK = "struct<name: string, img: array<double>, pitch: array<double>, line: array<array<double>>, pitch3: array<double>, line3: array<array<double>>, z: string>"
SCORE = "struct<turn: double, lines: boolean, precision: double, method: string, unsure: boolean>"


def clicks(points: Column) -> Column:
    """Clicks (array of structs as fits take them) from a JSON list: img, and pitch (a place), line (two places), pitch3 or line3 (with heights); z is the zoom. Broken JSON gives null. [SRC-06]"""

    def click(p: Column) -> Column:
        place, line = F.coalesce(p["pitch"], p["pitch3"]), F.coalesce(p["line"], p["line3"])
        end = lambda k, i: F.get(F.get(line, F.lit(k)), F.lit(i))
        on_line = place.isNull()
        up = F.when(p["pitch"].isNull() & p["line"].isNull(), F.coalesce(F.get(p["pitch3"], F.lit(2)), F.get(F.get(p["line3"], F.lit(0)), F.lit(2))))
        return F.struct(
            F.get(p["img"], F.lit(0)).alias("x"), F.get(p["img"], F.lit(1)).alias("y"), F.get(place, F.lit(0)).alias("px"), F.get(place, F.lit(1)).alias("py"),
            *[F.when(on_line, end(k, i)).alias(n) for n, k, i in (("ax", 0, 0), ("ay", 0, 1), ("bx", 1, 0), ("by", 1, 1))], up.alias("up"), p["z"].try_cast("double").alias("zoom"),
        )

    return F.transform(F.from_json(points, f"array<{CLICK}>"), click)


def score(text: Column) -> Column:
    """A proposal's score (struct turn, lines, precision, method, unsure) from JSON; keys that are absent are null. [SFN-34]"""
    return F.from_json(text, SCORE)
