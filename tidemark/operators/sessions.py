"""Detection of impulses in a stabilised picture against two witnesses of the motion, and measures of intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import gates as G
from . import islands as I
from .corrections import STRETCH, details
from .stats import MAD_TO_SIGMA
from .windows import hits, with_halo

# Limits of the detector, in degrees a second, seconds, or multiples of a robust scale.
LOCAL_S, PAD_S, MERGE_S, NEAR_S, APART_S = 0.12, 0.06, 0.12, 0.10, 0.25
CONFIDENCE = 0.20
AGREE_Z, AGREE_MOST, AGREE_FLOOR, SCORE_FLOOR = 4.0, 15.0, 0.35, 0.20
LARGE_Z, LARGE_LEAST, MICRO_Z, MICRO_LEAST, MICRO_HITS = 8.0, 5.0, 4.0, 2.0, 2
FAULT_LEAST, FAULT_OUTPUT, FAULT_AGAINST, FAULT_SOURCE, FAULT_HITS = 8.0, 5.0, 0.70, 8.0, 2
SUPPORT_Z, SUPPORT_LEAST = 20.0, 5.0

AXES = "xyz"


def length(columns: list[Column]) -> Column:
    return F.sqrt(reduce(Column.__add__, [c * c for c in columns]))


def _scaled(df: DataFrame, keys: list[str], values: list[str], use: str, floor: float) -> DataFrame:
    """df with k_<value>: 1.4826 times the median distance from the median over a series' rows where `use` holds, at least floor.

    Windows over the whole series, which the gap fill has dealt by key already: no join, and what comes before is computed once.
    """
    one = Window.partitionBy(*keys)
    middle = lambda c: F.percentile(F.when(F.col(use), c), F.lit(0.5)).over(one)
    df = df.select("*", *(middle(F.col(v)).alias(f"_m_{v}") for v in values))
    df = df.select("*", *(F.greatest(F.lit(floor), MAD_TO_SIGMA * middle(F.abs(F.col(v) - F.col(f"_m_{v}")))).alias(f"k_{v}") for v in values))
    return df.drop(*(f"_m_{v}" for v in values))


def strength(score: Column, impulse: Column) -> Column:
    """From 10 to 100: how far the geometric mean of two measures is over their limits."""
    over = F.sqrt(F.greatest(score / LARGE_Z, F.lit(1.0)) * F.greatest(impulse / LARGE_LEAST, F.lit(1.0)))
    return F.greatest(F.lit(10.0), F.least(F.lit(100.0), 10 + 90 * (1 - F.exp(-0.65 * (over - 1)))))


def scored(df: DataFrame, keys: list[str], order: str, dt: float) -> DataFrame:
    """df (gx.. of the gyro, sx.. of the source picture, tx.. of the stabilised one, conf_s and conf_t) with what detection
    needs of each row: valid, trusted, z, apart, score, impulse, fault, against, calm and the axis' scores ax, ay, az.

    Each value counts without its running median. Rows with a missing value or little confidence are not valid. A series with
    fewer than ten rows in which gyro and source agree is an error.
    """
    named = {k: [f"{k}{a}" for a in AXES] for k in "gst"}
    every = sum(named.values(), [])
    size = max(3, round(LOCAL_S / dt))
    valid = (F.col("conf_s") >= CONFIDENCE) & (F.col("conf_t") >= CONFIDENCE)
    for c in every:
        valid = valid & F.col(c).isNotNull()
    raw = df.select(*keys, order, F.coalesce(valid, F.lit(False)).alias("valid"), length([F.col(f"g{a}") - F.col(f"s{a}") for a in AXES]).alias("apart"), *every)
    d = details(raw, keys, order, every, size + 1 - size % 2)
    d = d.select("*", *((F.col(f"g{a}") - F.col(f"s{a}")).alias(f"e{a}") for a in AXES))
    off, out = [f"e{a}" for a in AXES], named["t"]
    d = _scaled(d, keys, off, "valid", AGREE_FLOOR)
    z = length([F.col(e) / F.col(f"k_{e}") for e in off]) / F.sqrt(F.lit(3.0))
    d = d.withColumn("z", z).withColumn("trusted", F.coalesce(F.col("valid") & (F.col("z") <= AGREE_Z) & (F.col("apart") <= AGREE_MOST), F.lit(False)))
    n = F.count_if("trusted").over(Window.partitionBy(*keys))
    d = d.withColumn("trusted", F.when(n < 10, F.raise_error(F.lit("too few rows where gyro and source agree")).cast("boolean")).otherwise(F.col("trusted")))
    d = _scaled(d, keys, out, "trusted", SCORE_FLOOR)
    d = d.select("*", *((F.abs(c) / F.col(f"k_{c}")).alias(f"a{a}") for c, a in zip(out, AXES)))
    d = d.select("*", F.greatest("ax", "ay", "az").alias("score"), *(length([F.col(c) for c in v]).alias(n) for n, v in (("impulse", out), ("fault", off), ("calm", named["s"]))))
    both = F.col("fault") * F.col("impulse")
    against = F.when(both > 1e-9, -sum((F.col(e) * F.col(t) for e, t in zip(off, out)), F.lit(0.0)) / both).otherwise(0.0)
    return d.withColumn("against", against)


def triggered(rows: DataFrame, keys: list[str], order: str, dt: float) -> DataFrame:
    """rows of scored() with large, micro, faulty, core (any of them) and trigger (core and what is near it).

    All windows share one deal of the rows into chunks, whose halo is as wide as the windows reach one after another.
    """
    near, apart, pad = max(3, round(NEAR_S / dt)), max(1, round(APART_S / dt)), max(0, round(PAD_S / dt))
    reach = near + apart + pad
    w = Window.partitionBy(*keys, "_chunk").orderBy(order)
    few, wide, edge = w.rowsBetween(-(near // 2), (near - 1) // 2), w.rowsBetween(-apart, apart), w.rowsBetween(-pad, pad)
    flag = lambda c: F.coalesce(c, F.lit(False))
    strong = lambda z, least: (F.col("score") >= z) & (F.col("impulse") >= least)
    d = with_halo(rows, order, reach, reach)
    fault = (F.col("fault") >= FAULT_LEAST) & (F.col("impulse") >= FAULT_OUTPUT) & (F.col("against") >= FAULT_AGAINST) & (F.col("calm") <= FAULT_SOURCE)
    d = d.select("*", flag(F.col("trusted") & strong(LARGE_Z, LARGE_LEAST)).alias("large"), flag(F.col("trusted") & strong(MICRO_Z, MICRO_LEAST)).alias("_micro"), flag(F.col("valid") & fault).alias("_fault"))
    d = d.select("*", (F.col("_micro") & (hits(F.col("_micro"), few) >= MICRO_HITS) & ~F.max("large").over(wide)).alias("micro"), (F.col("_fault") & (hits(F.col("_fault"), few) >= FAULT_HITS)).alias("_seed"))
    d = d.withColumn("faulty", F.max("_seed").over(wide) & flag(F.col("valid") & strong(SUPPORT_Z, SUPPORT_LEAST)))
    d = d.withColumn("core", F.col("large") | F.col("micro") | F.col("faulty"))
    d = d.withColumn("trigger", F.max("core").over(edge) & F.col("valid"))
    return d.where("_own").drop("_own", "_chunk", "_micro", "_fault", "_seed")


def outliers(df: DataFrame, keys: list[str], order: str, dt: float) -> DataFrame:
    """Events of each series: keys, id (from 1), start_s, end_s, duration_s, and of the strongest row its frame, axis, scores,
    strength, level and what was measured there; kind: gyro_fault before large_impulse before micro_jitter. Rows are dt seconds
    apart and order counts from 0."""
    told = F.struct(F.col(order).alias("frame"), "ax", "ay", "az", "score", "impulse", "z", "apart", "fault", "against", "calm")
    rank = F.when(F.col("core"), F.struct(F.round("score", 9), -F.col(order)))
    found = triggered(scored(df, keys, order, dt), keys, order, dt).where("trigger")
    runs = I.islands(found, keys, order, max(0, round(MERGE_S / dt)), F.max_by(told, rank).alias("p"), F.max("faulty").alias("faulty"), F.max("large").alias("large"))
    force = strength(F.col("p.score"), F.col("p.impulse"))
    axis = F.when((F.col("p.ax") >= F.col("p.ay")) & (F.col("p.ax") >= F.col("p.az")), "X").when(F.col("p.ay") >= F.col("p.az"), "Y").otherwise("Z/roll")
    return runs.select(
        *keys, (F.col("run") + 1).alias("id"),
        F.greatest(F.lit(0.0), F.col("first") * dt - dt / 2).alias("start_s"), (F.col("last") * dt + dt / 2).alias("end_s"), ((F.col("last") - F.col("first") + 1) * dt).alias("duration_s"),
        F.col("p.frame").alias("peak_frame"), axis.alias("peak_axis"), F.col("p.score").alias("peak_score"), F.col("p.impulse").alias("peak_impulse"),
        F.round(force, 1).alias("strength"), F.when(force < 35, "weak").when(force < 65, "medium").when(force < 85, "strong").otherwise("extreme").alias("level"),
        F.when(F.col("faulty"), "gyro_fault").when(F.col("large"), "large_impulse").otherwise("micro_jitter").alias("kind"),
        F.col("p.z").alias("agreement"), F.col("p.apart").alias("difference"), F.col("p.fault").alias("gyro_fault"), F.col("p.against").alias("against"), F.col("p.calm").alias("source_detail"),
    )


def interval_measures(df: DataFrame, spans: DataFrame, keys: list[str], order: str, case: str, values: list[str], detail: list[str], high: list[str], dt: float) -> DataFrame:
    """keys, case and eight measures of the rows of each span (first to last, both inclusive): peaks and root mean squares of
    speed, impulse and jerk, the root mean square above a frequency, and how far the summed speed less its mean strays. A span
    with fewer than two rows is an error, one that meets no row has none."""
    met = G.within(df.select(*keys, order, *values, *detail, *high), spans.select(*keys, case, "first", "last"), keys, order, "first", "last", STRETCH)
    one = Window.partitionBy(*keys, case)
    by = one.orderBy(order)
    met = met.withColumn("_n", F.count(F.lit(1)).over(one)).select("*", *((F.col(v) - F.avg(v).over(one)).alias(f"_c_{v}") for v in values))
    stray = length([F.sum(f"_c_{v}").over(by) * dt for v in values])
    met = met.select("*", stray.alias("_stray"), length([(F.col(v) - F.lag(v).over(by)) / dt for v in values]).alias("_jerk"), *(length([F.col(c) for c in s]).alias(n) for n, s in (("_speed", values), ("_impulse", detail), ("_high", high))))
    enough = F.when(F.max("_n") < 2, F.raise_error(F.lit("an interval has fewer than two rows")).cast("double")).otherwise(F.max("_stray"))
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    return met.groupBy(*keys, case).agg(enough.alias("excursion_peak"), *(f(f"_{n}").alias(f"{n}_{m}") for n in ("speed", "impulse", "jerk") for m, f in (("peak", F.max), ("rms", rms))), rms("_high").alias("high_rms"))
