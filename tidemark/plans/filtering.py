"""Queries over filters; SQL can't tell a recursion with these digits, so the tests check the filters themselves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import quaternion as Q
from ..operators import filters
from .series import K
from .views import duo, flat, r6, sig

FPS = 50.0


def w12_zero_phase(spark, sf_dir):
    low = filters.butterworth("low", 4.0, FPS)
    return filters.mapped(sig(spark, sf_dir), K, "frame", "x", "y", lambda x: filters.zero_phase(x, low)).select("clip_id", "frame", r6(F.col("y")).alias("y"))


def w12_band(spark, sf_dir):
    band = filters.butterworth("band", (2.0, 4.0), FPS)
    return filters.mapped(sig(spark, sf_dir), K, "frame", "x", "y", lambda x: filters.zero_phase(x, band)).select("clip_id", "frame", r6(F.col("y")).alias("y"))


def w13_spectral_gain(spark, sf_dir):
    f = lambda x: filters.spectral_gain(x, FPS, filters.GAIN_HZ, filters.GAIN_ROLL)
    return filters.mapped_whole(duo(spark, sf_dir), K, "frame", "ix", "y", f).select("clip_id", "frame", r6(F.col("y")).alias("y"))


def w14_reflected_gain(spark, sf_dir):
    f = lambda x: filters.spectral_gain(x, FPS, filters.GAIN_HZ, filters.GAIN_OTHER, reflect=100)
    return filters.mapped_whole(sig(spark, sf_dir), K, "frame", "x", "y", f).select("clip_id", "frame", r6(F.col("y")).alias("y"))


def a10_high_share(spark, sf_dir):
    return filters.band_share(sig(spark, sf_dir), K, "frame", "x", FPS, (15.0, 25.0), (2.0, 6.0)).select("clip_id", r6(F.col("share")).alias("share"))


def _seen(spark, sf_dir):
    """What the sensor tells, and what is seen of it, of rows that are calm."""
    return duo(spark, sf_dir).withColumn("calm", (F.col("rate") < 390) & (F.abs("x") < 4))


def a08_band_gain(spark, sf_dir):
    d = _seen(spark, sf_dir).withColumn("seen", F.coalesce("ix", F.col("x") * 0.7))
    return filters.band_gain(d, K, "frame", "x", "seen", F.col("calm"), FPS).select("clip_id", r6(F.col("gain")).alias("gain"))


def a09_spectral_keep(spark, sf_dir):
    d = _seen(spark, sf_dir).withColumn("seen", F.coalesce("ix", F.col("x") * 0.7))
    d = d.withColumn("calm", F.col("frame") % 700 < 600)
    return filters.spectral_keep(d, K, "frame", "x", "seen", F.col("calm"), FPS).select("clip_id", "hz", r6(F.col("keep")).alias("keep"))


def a26_band_table(spark, sf_dir):
    """How far each reading strays in three bands of its sums, without the ends, and its second differences."""
    d = duo(spark, sf_dir)
    each = d.select("clip_id", "frame", F.explode(F.array(F.struct(F.lit("told").alias("kind"), F.col("x").alias("v")), F.struct(F.lit("seen").alias("kind"), F.coalesce("ix", F.lit(0.0)).alias("v")))).alias("r")).select("clip_id", "frame", "r.*")
    own = ["clip_id", "kind"]
    by, one = Window.partitionBy(*own).orderBy("frame"), Window.partitionBy(*own)
    sums = each.withColumn("n", F.count(F.lit(1)).over(one)).withColumn("s", F.sum("v").over(by))
    out = None
    for low, high in ((1.0, 4.0), (4.0, 8.0), (8.0, 24.5)):
        band = filters.butterworth("band", (low, high), FPS)
        f = filters.filtered_all(sums, [*own, "n"], "frame", ["s"], lambda x, band=band: filters.zero_phase(x, band)).where("frame >= 10 and frame < n - 10")
        f = f.groupBy(*own).agg(r6(F.stddev_pop("s")).alias("rms")).withColumn("band", F.lit(f"{low:g}-{high:g}"))
        out = f if out is None else out.union(f)
    bend = each.withColumn("n", F.count(F.lit(1)).over(one)).withColumn("d", F.lead("v").over(by) - F.col("v")).where("frame >= 5 and frame < n - 6")
    return out.union(bend.groupBy(*own).agg(r6(F.sqrt(F.avg(F.col("d") * F.col("d"))) / F.sqrt(F.lit(2.0))).alias("rms")).withColumn("band", F.lit("step")))


def w15_smoothed_rotations(spark, sf_dir):
    """A slow turn with a wobble, whose sign jumps: smoothed without the jumps."""
    s = sig(spark, sf_dir)
    half = F.radians(F.col("frame") * 0.2 + F.col("x")) / 2
    sign = F.when(F.col("event_id") % 11 == 0, -1.0).otherwise(1.0)
    q = Q.quat(F.cos(half) * sign, F.lit(0.0), F.sin(half) * 0.6 * sign, F.sin(half) * 0.8 * sign)
    found = filters.smoothed_rotations(s.withColumn("q", q), K, "frame", "q", FPS, 2.0)
    return found.select("clip_id", "frame", *flat(F.col("q"), "q"))


QUERIES = {f.__name__: f for f in (w12_zero_phase, w12_band, w13_spectral_gain, w14_reflected_gain, a10_high_share, a08_band_gain, a09_spectral_keep, a26_band_table, w15_smoothed_rotations)}
ORACLE: dict[str, str] = {}
