"""Exports of a render's path, frame by frame: rates, their fast part, and where a path turns back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quaternion as Q
from . import filters
from . import gates as G


def flattened(exports: DataFrame, keys: list[str], order: str, paths: list[str], fps: float) -> DataFrame:
    """keys, order and, for each path (a struct of w, x, y, z): its parts at length one, its angles and its rates to the next frame
    (degrees a second, null at the end): <path>_w, <path>_pitch, <path>_rate_x and so on. Frames that are missing make no gap: the next one counts."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = exports.select(*keys, order, *(Q.normalized(F.col(p)).alias(p) for p in paths))
    d = d.select("*", *(F.lead(p).over(w).alias(f"_n_{p}") for p in paths))
    d = d.select("*", *(F.when(F.col(f"_n_{p}").isNotNull(), Q.increment(F.col(p), F.col(f"_n_{p}"))).alias(f"_v_{p}") for p in paths), *(Q.euler(F.col(p)).alias(f"_e_{p}") for p in paths))
    out = []
    for p in paths:
        out += [F.col(f"{p}.{k}").alias(f"{p}_{k}") for k in "wxyz"] + [F.col(f"_e_{p}.{a}").alias(f"{p}_{a}") for a in ("pitch", "yaw", "roll")]
        out += [(F.col(f"_v_{p}.{k}") * fps).alias(f"{p}_rate_{k}") for k in "xyz"]
    return d.select(*keys, order, *out)


def measures(rows: DataFrame, windows: DataFrame, keys: list[str], order: str, paths: list[str], fps: float, hz: float = 4.0) -> DataFrame:
    """keys, run, path, rms, fast_rms, fast_peak (degrees a second) and peak_frame of the rates of each path in each window.

    rows: those of flattened(), whose last of a series has no rate and is left out; windows: keys, run, a and b (frames, both inclusive); fast is what is above hz, filtered over the whole series.
    """
    names = [f"{p}_rate_{k}" for p in paths for k in "xyz"]
    known = rows.select(*keys, order, *names).dropna(subset=names)
    high = filters.butterworth("high", hz, fps)
    fast = filters.filtered_all(known, keys, order, names, lambda x: filters.zero_phase(x, high, 9)).select(*keys, order, *(F.col(n).alias(f"_h_{n}") for n in names))
    met = G.within(known.join(fast, [*keys, order]), windows.select(*keys, "run", "a", "b"), keys, order, "a", "b", 64)
    length = lambda prefix, p: F.sqrt(sum((F.col(f"{prefix}{p}_rate_{k}") * F.col(f"{prefix}{p}_rate_{k}") for k in "xyz"), F.lit(0.0)))
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("path"), length("", p).alias("v"), length("_h_", p).alias("h")) for p in paths))).alias("e")
    flat = met.select(*keys, "run", order, each).select(*keys, "run", order, "e.*")
    root = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    return flat.groupBy(*keys, "run", "path").agg(root("v").alias("rms"), root("h").alias("fast_rms"), F.max("h").alias("fast_peak"), F.max_by(order, F.struct("h", -F.col(order))).alias("peak_frame"))


def turning_points(rows: DataFrame, windows: DataFrame, keys: list[str], order: str, angles: dict[str, int]) -> DataFrame:
    """keys, run, angle, frame, value and back: of each angle (a column, with 1 for its top or -1 for its bottom) where in the window it turns, and
    how far it has come back at the window's end. Of equal values the first counts."""
    met = G.within(rows.select(*keys, order, *angles), windows.select(*keys, "run", "a", "b"), keys, order, "a", "b", 64)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("angle"), F.col(n).alias("v"), F.lit(float(s)).alias("s")) for n, s in angles.items()))).alias("e")
    flat = met.select(*keys, "run", order, each).select(*keys, "run", order, "e.*").where("v is not null")
    top = F.max_by(F.struct(order, "v"), F.struct(F.col("s") * F.col("v"), -F.col(order)))
    found = flat.groupBy(*keys, "run", "angle").agg(top.alias("t"), F.max_by("v", order).alias("_end"))
    return found.select(*keys, "run", "angle", F.col(f"t.{order}").alias(order), F.col("t.v").alias("value"), (F.col("_end") - F.col("t.v")).alias("back"))
