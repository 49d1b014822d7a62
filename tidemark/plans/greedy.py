"""Queries over rules that SQL can't tell; the tests check the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import islands as I
from ..operators import sequential as S
from .series import K
from .views import duo, r6, sig


def i13_segments(spark, sf_dir):
    runs = I.islands(sig(spark, sf_dir).where("x >= 3"), K, "frame", 5)
    return S.packed_segments(runs, K, "first", "last", 20.0, 120.0).select("clip_id", "start", "end", "n")


def i18_spaced_peaks(spark, sf_dir):
    return S.spaced_top(sig(spark, sf_dir), K, "frame", "x", 8, 10).select("clip_id", "frame", r6(F.col("x")).alias("x"), "place")


def q15_thinned_samples(spark, sf_dir):
    return S.thinned(sig(spark, sf_dir).select("clip_id", "frame", "us"), K, "us", 60_000_000.0)


def q16_reintegration(spark, sf_dir):
    d = duo(spark, sf_dir).withColumn("dt", F.lit(0.02))
    return S.reintegrated(d, K, "frame", ("x", "y", "z"), "dt").select("clip_id", "frame", *(r6(F.col(k)).alias(k) for k in "wxyz"))


QUERIES = {f.__name__: f for f in (i13_segments, i18_spaced_peaks, q15_thinned_samples, q16_reintegration)}
ORACLE: dict[str, str] = {}
