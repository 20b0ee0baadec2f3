"""Cheering and whistles from sound features: clip_id, k (tenth of a second), level (dB), bright, low, w_frac, w_peak."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from trackmill.operators import choose, sequences, timejoins

RATE = 16_000


def features(audio: DataFrame) -> DataFrame:
    """Per tenth of a second of audio (clip_id, k, samples: mono sound of 16 kHz around it): level of voices in dB, share of their tones over 1 kHz,
    share of all below 300 Hz, share of the whistle's band, and how far its strongest tone stands out. [SFN-27]"""

    def one(x: list[float] | None) -> tuple:
        x = np.asarray(x or [0.0], float)
        hz = np.fft.rfftfreq(len(x), 1 / RATE)
        p = np.abs(np.fft.rfft(x * np.hanning(len(x)))) ** 2
        voice, whistle = p[(hz >= 300) & (hz <= 4000)].sum(), p[(hz >= 2000) & (hz <= 4500)]
        high, low, heard = p[(hz >= 1000) & (hz <= 4000)].sum(), p[hz < 300].sum(), p[hz >= 150].sum()
        return 10 * np.log10(voice + 1e-9), high / (voice + 1e-12), low / (p.sum() + 1e-12), whistle.sum() / (heard + 1e-9), (whistle.max() / (whistle.mean() + 1e-12)) if len(whistle) else 0.0

    def rows(batches):
        for batch in batches:
            out = [one(x) for x in batch.column("samples").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("clip_id"), batch.column("k"), *[pa.array([float(r[i]) for r in out], pa.float64()) for i in range(5)]], ["clip_id", "k", "level", "bright", "low", "w_frac", "w_peak"])

    return audio.select(F.col("clip_id").cast("long"), F.col("k").cast("long"), "samples").mapInArrow(rows, "clip_id long, k long, level double, bright double, low double, w_frac double, w_peak double")


def with_background(f: DataFrame, reach: int = 15) -> DataFrame:
    """Features with `excess`, the level over the background: medians of seconds, their median over 15 seconds before and after, linear between the seconds' centres. [WIN-13]"""
    n = f.groupBy("clip_id").agg(F.greatest(F.lit(1), F.floor(F.count("*") / 10)).alias("blocks"))
    b = f.withColumn("b", F.floor(F.col("k") / 10)).join(n, "clip_id").where("b < blocks").groupBy("clip_id", "b").agg(F.percentile("level", 0.5).alias("m"), F.first("blocks").alias("blocks"))
    b = sequences.rolling_median(b, ["clip_id"], ["b"], "m", reach, "bg").select("clip_id", "b", "bg")
    x = F.col("k") / 10 - 0.5  # in blocks from the first centre
    low = F.greatest(F.lit(0), F.least(F.floor(x), F.col("blocks") - 1))
    g = f.join(n, "clip_id").withColumn("lo", low).withColumn("hi", F.least(low + 1, F.col("blocks") - 1)).withColumn("w", F.least(F.lit(1.0), F.greatest(F.lit(0.0), x - low)))
    g = g.join(b.select("clip_id", F.col("b").alias("lo"), F.col("bg").alias("bg0")), ["clip_id", "lo"]).join(b.select("clip_id", F.col("b").alias("hi"), F.col("bg").alias("bg1")), ["clip_id", "hi"])
    return g.withColumn("excess", F.col("level") - (F.col("bg0") * (1 - F.col("w")) + F.col("bg1") * F.col("w"))).drop("blocks", "lo", "hi", "w", "bg0", "bg1")


def sound_events(f: DataFrame) -> DataFrame:
    """Cheers and whistles: clip_id, kind, t, t_end, score; the strongest of a kind in half a minute. [SFN-28, WIN-12, TOP-05, QRY-08]"""
    t = with_background(f).withColumn("tonal", (F.col("w_frac") > 0.4) & (F.col("w_peak") > 25.0) & (F.col("excess") > -3.0))
    span = lambda mask, bridge: sequences.mask_groups(t, ["clip_id"], "k", mask, bridge).select("clip_id", "first", "last")

    def inside(spans: DataFrame) -> GroupedData:
        """Tenths of a second by the span that they are in: of spans, which don't overlap, the last that has begun."""
        found = timejoins.as_of(t, spans.withColumnRenamed("first", "k"), ["clip_id"], "k", "last", name="span").withColumn("first", F.col("span.t")).withColumn("last", F.col("span.v"))
        return found.where("k <= last").groupBy("clip_id", F.col("first"), F.col("last"))

    dur = (F.col("last") - F.col("first") + 1) / 10
    cheer = inside(span(F.col("excess") > 8.0, 3)).agg(F.avg(F.col("tonal").cast("int")).alias("tonal"), F.avg("bright").alias("bright"), F.avg("low").alias("low"), F.avg("excess").alias("e"))
    cheer = cheer.where((dur >= 1.5) & (F.col("tonal") <= 0.5) & (F.col("bright") >= 0.12) & (F.col("low") <= 0.6)).withColumn("score", F.round(F.col("e") * F.sqrt(F.least(dur, F.lit(6.0))), 1))
    whistle = inside(span(F.col("tonal"), 1)).agg(F.avg("w_peak").alias("p")).where(dur.between(0.2, 4.0)).withColumn("score", F.round(F.col("p") / 10 * F.least(dur, F.lit(2.0)), 1))
    pick = lambda df, kind: df.select("clip_id", F.lit(kind).alias("kind"), F.col("first").alias("k"), F.col("last"), "score")
    both = pick(cheer, "cheer").unionByName(pick(whistle, "whistle"))
    kept = choose.suppressed(both, ["clip_id", "kind"], "k", "score", "last", 300)
    return kept.select("clip_id", "kind", F.round(F.col("k") / 10, 1).alias("t"), F.round((F.col("last") + 1) / 10, 1).alias("t_end"), "score")


def current(cache: DataFrame, version: int) -> DataFrame:
    """Stored events of the present rules' version alone; clips without any are analysed again. [SNK-09]"""
    return cache.where(F.col("version") == version)


def highlights(events: DataFrame, clips: DataFrame, most: int = 80) -> DataFrame:
    """Events of a match in its clips' order, cheering first where a list is cut to `most`. [QRY-08, FLT-14]"""
    w = Window.partitionBy("match_id").orderBy(F.when(F.col("kind") == "cheer", 0).otherwise(1), F.desc("score"), "clip_id", "t")
    e = events.join(clips.select(F.col("id").alias("clip_id"), "match_id", "order_idx"), "clip_id").withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    return e.drop("k").orderBy("match_id", "order_idx", "t")
