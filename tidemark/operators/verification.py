"""Readings held against each other: attitudes of two readers, a motion at a recording's frames, and what is left of a path second by second."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quaternion as Q
from . import asof
from .windows import framed


def parse_check(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, matched and worst: samples of ours whose whole number t is a key of theirs, or else the next one or the one before, and
    the largest difference of a component (null if none matched). ours: keys, t and q; theirs: keys, key and q; its keys are distinct."""
    at = F.col("t").cast("long")
    tries = ours.select(*keys, F.col("t").alias("_t"), F.col("q").alias("_q"), F.posexplode(F.array(at, at + 1, at - 1)).alias("_turn", "key"))
    met = tries.join(theirs.select(*keys, "key", "q"), [*keys, "key"], "left")
    met = met.groupBy(*keys, "_t").agg(F.first("_q").alias("_q"), F.min_by("q", F.when(F.col("q").isNotNull(), F.col("_turn"))).alias("q"))
    off = F.when(F.col("q").isNotNull(), F.greatest(*(F.abs(F.col(f"_q.{p}") - F.col(f"q.{p}")) for p in Q.PARTS)))
    return met.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("q").alias("matched"), F.max(off).alias("worst"))


def series_at_frames(samples: DataFrame, counts: DataFrame, keys: list[str], fps: float, shift_ms: float = 0.0) -> DataFrame:
    """keys, frame, q and v: the attitude at each of a recording's frames and one beyond, read shift_ms later, and the rotation vector (degrees) from
    there to the next, null at the last. samples: keys, t (microseconds) and q; counts: keys and n, frames. The end samples hold beyond the ends."""
    frames = counts.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long"))).alias("frame"))
    asked = frames.withColumn("t", F.col("frame") * (1e6 / fps) + shift_ms * 1000)
    at = asof.slerped(samples.select(*keys, "t", "q"), asked, keys, "t", "q", asof.STRETCH_S * 1e6)
    return framed(at, keys, "frame", 0, 1, {"_next": lambda _, w: F.lead("q").over(w)}).select(*keys, "frame", "q", F.when(F.col("_next").isNotNull(), Q.increment(F.col("q"), F.col("_next"))).alias("v"))


def second_paths(df: DataFrame, keys: list[str], order: str, values: list[str], fps: float) -> DataFrame:
    """keys, order, second and values, each as its sum since its second began, less the quadratic through that second's sums.

    Done second by second, so that a large motion does not leak into the quiet seconds beside it. Order is dense and counts from 0; a missing value
    adds nothing; of seconds of three rows or fewer nothing is left.
    """
    size = max(1, round(fps))
    own = Window.partitionBy(*keys, "second")
    d = df.select(*keys, order, *values, F.floor(F.col(order) / size).alias("second"))
    so_far = own.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"_n": F.count(F.lit(1)).over(own).cast("double"), "_i": F.row_number().over(own.orderBy(order)), **{f"_y_{v}": F.sum(F.coalesce(F.col(v), F.lit(0.0))).over(so_far) for v in values}})
    d = d.withColumn("_u", F.col("_i") - (F.col("_n") + 1) / 2)
    n, u = F.col("_n"), F.col("_u")
    d = d.withColumns({f"_{v}_{k}": F.sum(F.col(f"_y_{v}") * F.pow(u, F.lit(float(k)))).over(own) for v in values for k in (0, 1, 2)})
    # sums of the second and fourth powers of places about their middle
    s2, s4 = n * (n * n - 1) / 12, n * (n * n - 1) * (3 * n * n - 7) / 240
    det = n * s4 - s2 * s2

    def left(v: str):
        a0, a1, a2 = (F.col(f"_{v}_{k}") for k in (0, 1, 2))
        trend = (a0 * s4 - a2 * s2) / det + a1 / s2 * u + (n * a2 - s2 * a0) / det * u * u
        return F.when(n > 3, F.col(f"_y_{v}") - trend).otherwise(0.0)

    return d.select(*keys, order, "second", *(left(v).alias(v) for v in values))
