"""Queries over corrections and flags that rest on recursive filters; SQL can't tell these, the tests hold them against numpy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adaptive, filters
from .filtering import FPS
from .series import K
from .views import duo, r6


def _readings(spark, sf_dir):
    """Two readings that differ by some hundredths of a degree, of which the second misses every 29th event."""
    d = duo(spark, sf_dir)
    noise = lambda k: (F.col("event_id") * k % 1009) / 504.5 - 1
    told = {a: F.col(a) / 12 for a in "xyz"}
    seen = {f"i{a}": F.when(F.col(f"i{a}").isNotNull(), F.col(f"i{a}") / 9.6 + noise(k) * 0.04) for a, k in (("x", 17), ("y", 19), ("z", 23))}
    rest = {"curl": F.coalesce(F.col("iz") / 9.6 + noise(23) * 0.04, F.lit(0.0)) + noise(29) * 0.01, "points": 300 + F.col("event_id") % 100, "rate": F.col("rate") / 8, "valid": F.col("frame") >= 10}
    rough = F.when(F.col("frame") % 1000 < 40, 6.0).otherwise(1.0)
    render = {c: noise(k) * 4 * rough for c, k in (("rx", 31), ("ry", 37), ("rr", 41))}
    return d.select("clip_id", "frame", *(c.alias(n) for n, c in {**told, **seen, **rest, **render}.items()))


def i26_roll_correction(spark, sf_dir):
    d = _readings(spark, sf_dir).withColumn("told", F.col("z")).withColumn("seen", F.col("iz"))
    return adaptive.roll_correction(d, K, "frame", FPS).select("clip_id", "frame", r6(F.col("theta")).alias("theta"), r6(F.col("gate")).alias("gate"))


def i11_flags(spark, sf_dir):
    found = adaptive.flags(_readings(spark, sf_dir), K, "frame", FPS)
    return found.select(*(r6(F.col(c)).alias(c) if c in ("jump", "jitter", "curl", "jerk") else c for c in found.columns))


def a25_path_map(spark, sf_dir):
    found = adaptive.path_map(_readings(spark, sf_dir), K, "frame", ["x", "y", "z"], ["ix", "iy", "iz"], FPS)
    return found.select("clip_id", "axis", *(r6(F.col(c)).alias(c) for c in "abc"))


def a25_path_bands(spark, sf_dir):
    d = _readings(spark, sf_dir)
    path, render = ["x", "y", "z"], ["ix", "iy", "iz"]
    found = adaptive.path_bands(d, adaptive.path_map(d, K, "frame", path, render, FPS), K, "frame", path, render, FPS)
    return found.select("clip_id", "axis", "band", *(r6(F.col(c)).alias(c) for c in ("total", "by_path", "left")))


def c03_denoised(spark, sf_dir):
    gains = [filters.GAIN_OTHER, filters.GAIN_OTHER, filters.GAIN_ROLL]
    found = adaptive.denoised(_readings(spark, sf_dir), K, "frame", ["x", "y", "z"], "rate", gains, FPS)
    return found.select("clip_id", "frame", *(r6(F.col(a)).alias(a) for a in "xyz"))


QUERIES = {f.__name__: f for f in (i26_roll_correction, i11_flags, a25_path_map, a25_path_bands, c03_denoised)}
ORACLE: dict[str, str] = {}
