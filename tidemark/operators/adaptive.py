"""Corrections and flags that weigh two readings of a motion by how far each can be trusted, put together from filters,
windows and robust errors a second."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import filters
from .stats import MAD_TO_SIGMA, PLANE, plane_of
from .windows import cumulative_before, edge_padded, framed, with_halo

# Limits of what is corrected and flagged, in degrees, degrees a second, frames or seconds.
HIGH_HZ, SLOW_BAND, CURL_MOST, POINTS_LEAST = 4.0, (1.0, 4.0), 0.03, 300
FAST, FAST_S, BUSY, BUSY_S, FIT_FASTEST, CALM = 60.0, 0.1, 30.0, 1.0, 150.0, 45.0
SOFT_HIGH, SOFT_SLOW = 120.0, 15.0
DEFECT, NEAREST, NEAREST_LEAST, REACH_S = (0.018, 0.025), 7, 5, 20
SPIKE, SPIKE_FASTEST, JITTER, BAD_FASTEST, JERK, JERK_RATIO, JERK_FASTEST = 0.35, 200.0, 0.05, 100.0, 4.0, 3.0, 60.0


def _joined(df: DataFrame, other: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.join(other, [*keys, order])


def _passed(df: DataFrame, keys: list[str], order: str, columns: dict[str, Column], sections: list) -> DataFrame:
    """df with columns, each the filtered value of an expression, nulls as zero; in chunks with a halo, without a join."""
    slim = with_halo(df.select("*", *(c.cast("double").alias(n) for n, c in columns.items())), order, filters.HALO, filters.HALO, filters.CHUNK)
    schema = T.StructType([f for f in slim.schema if f.name not in ("_own", "_chunk")])
    names = list(columns)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        for n in names:
            group[n] = filters.zero_phase(np.nan_to_num(group[n].to_numpy(float)), sections)
        return group.loc[group["_own"], schema.names]

    return slim.groupBy(*keys, "_chunk").applyInPandas(run, schema)


def _rms(df: DataFrame, keys: list[str], order: str, columns: dict[str, list[Column]], rows: int) -> DataFrame:
    """df with columns: the root of the summed mean squares of their values in `rows` rows around each; beyond the ends nothing is."""
    squares = df.select("*", *(reduce(Column.__add__, [v * v for v in values]).alias(f"_q_{n}") for n, values in columns.items()))
    out = framed(squares, keys, order, rows // 2, (rows - 1) // 2, {n: (lambda w, _, n=n: F.sqrt(F.sum(f"_q_{n}").over(w) / rows)) for n in columns})
    return out.drop(*(f"_q_{n}" for n in columns))


def _near(df: DataFrame, keys: list[str], order: str, flags: dict[str, tuple[Column, int]]) -> DataFrame:
    """df with flags: whether an expression holds at most so many rows away."""
    widest = max(reach for _, reach in flags.values())
    named = df.select("*", *(F.coalesce(c, F.lit(False)).alias(f"_f_{n}") for n, (c, _) in flags.items()))
    out = framed(named, keys, order, widest, widest, {n: (lambda _, w, n=n, reach=reach: F.max(f"_f_{n}").over(w.rowsBetween(-reach, reach))) for n, (_, reach) in flags.items()})
    return out.drop(*(f"_f_{n}" for n in flags))


def half_second(fps: float) -> int:
    return max(5, round(0.5 * fps))


def second_gate(rows: DataFrame, keys: list[str], order: str, error: str, calm: str, fps: float) -> DataFrame:
    """keys, order and gate: how far the defect shows at each row, from 0 to 1.

    A second of which more than half is calm has an error, 1.4826 times the median of |error| over its calm rows. A second's
    gate is a ramp of the median of its nearest seconds with errors, times that ramp of the median of all; rows between the
    middles of two seconds are on the line between their gates.
    """
    size = max(1, round(fps))
    ramp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - DEFECT[0]) / (DEFECT[1] - DEFECT[0])))
    by_second = rows.groupBy(*keys, F.floor(F.col(order) / size).cast("int").alias("_s")).agg(F.max(order).alias("_top"), F.count_if(calm).alias("_n"), (MAD_TO_SIGMA * F.percentile(F.when(F.col(calm), F.abs(error)), F.lit(0.5))).alias("_e"))
    have = by_second.where(F.col("_n") > 0.5 * size).select(*keys, F.col("_s").alias("_o"), "_e")
    last = by_second.groupBy(*keys).agg(F.floor((F.max("_top") + 1) / size).cast("int").alias("_last"))
    every = last.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("_s"))
    reach = every.select(*keys, "_s", F.explode(F.sequence(F.col("_s") - REACH_S, F.col("_s") + REACH_S)).alias("_o"))
    place = F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(F.abs(F.col("_s") - F.col("_o")), "_o"))
    near = reach.join(have, [*keys, "_o"]).withColumn("_k", place).where(F.col("_k") <= NEAREST)
    near = near.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_n"), F.percentile("_e", F.lit(0.5)).alias("_m")).where(F.col("_n") >= NEAREST_LEAST)
    whole = have.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"), F.percentile("_e", F.lit(0.5)).alias("_w")).where(F.col("_c") >= NEAREST_LEAST)
    told = every.join(near, [*keys, "_s"], "left").join(whole, keys, "left").select(*keys, "_s", F.coalesce(ramp(F.col("_m")) * ramp(F.col("_w")), F.lit(0.0)).alias("_g"))
    told = told.withColumn("_next", F.coalesce(F.lead("_g").over(Window.partitionBy(*keys).orderBy("_s")), F.col("_g")))
    at = F.greatest(F.col(order) / fps - 0.5, F.lit(0.0))
    end = F.floor((F.max(order).over(Window.partitionBy(*keys)) + 1) / size)
    met = rows.select(*keys, order, at.alias("_at"), end.alias("_end")).withColumn("_s", F.least(F.floor("_at"), F.col("_end")).cast("int")).join(told, [*keys, "_s"])
    return met.select(*keys, order, (F.col("_g") + (F.col("_next") - F.col("_g")) * F.least(F.col("_at") - F.col("_s"), F.lit(1.0))).alias("gate"))


def roll_correction(df: DataFrame, keys: list[str], order: str, fps: float) -> DataFrame:
    """keys, order, theta (degrees) and gate: the roll that is seen in place of the roll that is told, where its defect shows.

    df: told, seen (null where unknown), curl (a second estimate of what is seen), points (null: enough), rate, valid. What is
    seen counts where its two estimates agree above HIGH_HZ, enough points carry it and nothing near is fast. Above HIGH_HZ
    its weight falls with the rate; in SLOW_BAND it falls faster, and rows near a busy one have none. Order counts from 0.
    """
    high = filters.butterworth("high", HIGH_HZ, fps)
    d = df.select(*keys, order, "seen", "points", "rate", "valid", F.when(F.col("valid"), F.col("told")).otherwise(0.0).alias("_t"), F.col("told"), F.coalesce("curl", F.lit(0.0)).alias("_c"))
    d = _passed(d, keys, order, {"_hs": F.col("seen"), "_hc": F.col("_c"), "_ht": F.col("_t")}, high)
    d = d.withColumn("_has", F.col("seen").isNotNull() & F.col("valid"))
    d = _rms(d, keys, order, {"_kc": [F.when(F.col("_has"), F.col("_hs") - F.col("_hc")).otherwise(0.0)]}, half_second(fps))
    d = _near(d, keys, order, {"_fast": (F.col("rate") > FAST, max(1, round(FAST_S * fps))), "_busy": (F.col("rate") > BUSY, max(1, round(BUSY_S * fps)))})
    ok = F.col("_has") & (F.col("_kc") < CURL_MOST) & (F.coalesce("points", F.lit(POINTS_LEAST)) >= POINTS_LEAST) & ~F.col("_fast")
    d = d.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    gain = filters.band_gain(d, keys, order, "_t", "seen", F.col("_ok") & (F.col("rate") < FIT_FASTEST), fps)
    d = d.join(gain, keys)
    off = F.when(F.col("_ok"), F.col("seen") / F.col("gain") - F.col("told")).otherwise(0.0)
    soft = lambda use, r: F.when(use, 1 / (1 + F.pow(F.col("rate") / r, F.lit(2.0)))).otherwise(0.0)
    error = F.when(F.col("_ok"), F.col("_hs") / F.col("gain") - F.col("_ht")).otherwise(0.0)
    d = d.select(*keys, order, (soft(F.col("_ok"), SOFT_HIGH) * off).alias("_hi"), (soft(F.col("_ok") & ~F.col("_busy"), SOFT_SLOW) * off).alias("_lo"), error.alias("_err"), (F.col("_ok") & (F.col("rate") < CALM)).alias("_calm"))
    d = _joined(d.drop("_err", "_calm"), second_gate(d, keys, order, "_err", "_calm", fps), keys, order)
    sums = d.select(*keys, order, "gate", *(cumulative_before(F.col("gate") * F.col(c), keys, order).alias(c) for c in ("_hi", "_lo")))
    fast, slow = filters.butterworth("band", (SLOW_BAND[1], fps / 2 * 0.992), fps), filters.butterworth("band", SLOW_BAND, fps)
    out = _passed(_passed(sums, keys, order, {"_ph": F.col("_hi")}, fast), keys, order, {"_pl": F.col("_lo")}, slow)
    return out.select(*keys, order, (F.col("_ph") + F.col("_pl")).alias("theta"), "gate")


def flags(df: DataFrame, keys: list[str], order: str, fps: float) -> DataFrame:
    """keys, order, spike, confirmed, tel_jitter, image_bad and render_jerk, with what they rest on: jump, jitter, curl, jerk.

    df: x, y, z as told, ix, iy, iz as seen (null where unknown), curl, points, rate, valid, and rx, ry, rr: what is left in a
    render, in pixels (null where unknown). A jump over the running median of five is confirmed where what is seen goes
    against it; jitter is where told and seen differ above HIGH_HZ; a picture is bad where its two estimates differ there.
    """
    axes, high, rows = "xyz", filters.butterworth("high", HIGH_HZ, fps), half_second(fps)
    has = reduce(Column.__and__, [F.col(f"i{a}").isNotNull() for a in axes]) & F.col("valid")
    left = reduce(Column.__and__, [F.col(c).isNotNull() for c in ("rx", "ry", "rr")])
    d = df.select("*", has.alias("_has"), left.alias("_left"), *(F.when(F.col("valid"), F.col(a)).otherwise(0.0).alias(f"_v{a}") for a in axes))
    others = [c for c in d.columns if c not in (*keys, order)]
    middle = {f"_m{a}": (lambda w, _, a=a: F.percentile(f"_v{a}", F.lit(0.5)).over(w)) for a in axes}
    d = framed(edge_padded(d, keys, order, 2, others), keys, order, 2, 2, middle).where("_real").drop("_real")
    d = _passed(d, keys, order, {**{f"_hi{a}": F.col(f"i{a}") for a in axes}, **{f"_ht{a}": F.col(a) for a in axes}, "_hc": F.col("curl")}, high)
    d = _rms(d, keys, order, {"_kc": [F.when(F.col("_has"), F.col("_hiz") - F.col("_hc")).otherwise(0.0)]}, rows)
    ok = F.col("_has") & (F.col("_kc") < CURL_MOST) & (F.coalesce("points", F.lit(0)) >= POINTS_LEAST)
    d = d.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    fit = F.col("_ok") & (F.col("rate") < FIT_FASTEST)
    for gain in [filters.band_gain(d, keys, order, a, f"i{a}", fit, fps).withColumnRenamed("gain", f"_g{a}") for a in axes]:
        d = d.join(gain, keys)
    # filters are linear: a gain goes through them
    e = [F.when(F.col("_has"), F.col(f"_hi{a}") / F.col(f"_g{a}") - F.col(f"_ht{a}")).otherwise(0.0) for a in axes]
    d = _rms(d, keys, order, {"jitter": e}, rows)
    d = d.select("*", *((F.col(a) - F.col(f"_m{a}")).alias(f"_r{a}") for a in axes))
    jump = F.sqrt(reduce(Column.__add__, [F.col(f"_r{a}") * F.col(f"_r{a}") for a in axes]))
    against = reduce(Column.__add__, [F.when(F.col("_has"), F.col(f"i{a}") / F.col(f"_g{a}") - F.col(a)).otherwise(0.0) * F.col(f"_r{a}") for a in axes])
    d = d.withColumn("jump", jump).withColumn("confirmed", against < -0.5 * F.col("jump") * F.col("jump"))
    by = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("*", *(F.sum(F.when(F.col("_left"), F.col(c)).otherwise(0.0)).over(by).alias(f"_s{c}") for c in ("rx", "ry", "rr")))
    d = _passed(d, keys, order, {f"_p{c}": F.col(f"_s{c}") for c in ("rx", "ry", "rr")}, filters.butterworth("band", (HIGH_HZ, min(24.5, fps / 2 * 0.98)), fps))
    d = _rms(d, keys, order, {"jerk": [F.col(f"_p{c}") for c in ("rx", "ry", "rr")]}, rows)
    quiet = F.col("_left") & (F.col("rate") < CALM) & F.col("valid")
    whole = Window.partitionBy(*keys)
    usual = lambda c: F.percentile(F.when(c, F.col("jerk")), F.lit(0.5)).over(whole)
    d = d.withColumn("_base", F.when(F.count_if(quiet).over(whole) > 100, usual(quiet)).otherwise(usual(F.col("_left"))))
    told = {
        "spike": (F.col("jump") >= SPIKE) & F.col("valid") & (F.col("rate") < SPIKE_FASTEST),
        "confirmed": F.col("confirmed"),
        "tel_jitter": (F.col("jitter") >= JITTER) & F.col("_ok") & (F.col("rate") < FIT_FASTEST) & F.col("valid"),
        "image_bad": ~F.col("_ok") & F.col("valid") & (F.col("rate") < BAD_FASTEST),
        "render_jerk": (F.col("jerk") >= F.greatest(F.lit(JERK), JERK_RATIO * F.col("_base"))) & F.col("_left") & (F.col("rate") < JERK_FASTEST) & F.col("valid"),
    }
    return d.select(*keys, order, *(F.coalesce(c, F.lit(False)).alias(n) for n, c in told.items()), "jump", "jitter", F.col("_kc").alias("curl"), "jerk")


def path_map(df: DataFrame, keys: list[str], order: str, path: list[str], render: list[str], fps: float, band: tuple[float, float] = (0.3, 3.0), edge: int = 10, chunk: int = filters.CHUNK, halo: int = filters.HALO) -> DataFrame:
    """keys, axis (of the render) and a, b, c: the least squares map from a path's three axes to each of the render's, on the
    filtered sums of both without the ends; order counts from 0."""
    sections = filters.butterworth("band", band, fps)
    names = [f"s{i}{j}" for i, j in PLANE] + [f"t{i}" for i in range(3)]

    def told(sums: np.ndarray, inner: np.ndarray):
        found = filters.zero_phase(sums, sections)[:, inner]
        products = found @ found[:3].T
        for k, r in enumerate(render):
            yield (r, *(products[i, j] for i, j in PLANE), *products[3 + k])

    parts = filters.told_of_sums(df, keys, order, [*path, *render], told, {"axis": "string", **dict.fromkeys(names, "double")}, edge, chunk, halo)
    return plane_of(parts.groupBy(*keys, "axis").agg(*(F.sum(n).alias(n) for n in names)), [*keys, "axis"])


def path_bands(df: DataFrame, maps: DataFrame, keys: list[str], order: str, path: list[str], render: list[str], fps: float, bands: tuple = ((0.3, 1.0), (1.0, 4.0), (4.0, 8.0), (8.0, 24.5)), edge: int = 10, chunk: int = filters.CHUNK, halo: int = filters.HALO) -> DataFrame:
    """keys, axis, band, total, by_path and left: how far the render strays in each band of its sums, what of it the
    path explains by maps, a table of path_map(), and what it does not. An axis without a map has no rows.

    All bands of all axes are told of a chunk at once: its rows, and of each of the three values their mean and squares off it.
    """
    passes = [(f"{low:g}-{top:g}", filters.butterworth("band", (low, top), fps)) for low, top in bands]
    # a row for each series is sent to all tasks, so that no task gets a whole series
    by_axis = F.broadcast(maps.groupBy(*keys).agg(*(F.max(F.when(F.col("axis") == r, F.struct("a", "b", "c"))).alias(f"_m{i}") for i, r in enumerate(render))))
    path_sum = lambda m: reduce(Column.__add__, [F.coalesce(p, F.lit(0.0)) * F.col(f"{m}.{k}") for p, k in zip(path, "abc")])
    met = df.join(by_axis, keys)
    # a map without numbers tells nothing, of what is explained or of the rest
    of = [(F.coalesce(r, F.lit(0.0)), path_sum(f"_m{i}")) for i, r in enumerate(render)]
    rows = met.select(*keys, order, *(v.alias(f"_{n}{i}") for i, (r, p) in enumerate(of) for n, v in (("r", r), ("p", p), ("u", r - p), ("h", F.when(F.col(f"_m{i}").isNotNull(), 1.0)))))
    values = [f"_{n}{i}" for n in "rpuh" for i in range(len(render))]
    names = [f"{n}{v}" for v in "rpu" for n in ("m", "q")]

    def told(sums: np.ndarray, inner: np.ndarray):
        n, mapped = len(inner), sums[-len(render) :, -1] > 0
        for band, sections in passes:
            found = filters.zero_phase(sums[: -len(render)], sections)[:, inner]
            mean = found.mean(1)
            off = ((found - mean[:, None]) ** 2).sum(1)
            for k, r in enumerate(render):
                if mapped[k]:
                    yield (r, band, n, *(x[k + i * len(render)] for i in range(3) for x in (mean, off)))

    parts = filters.told_of_sums(rows, keys, order, values, told, {"axis": "string", "band": "string", "n": "long", **dict.fromkeys(names, "double")}, edge, chunk, halo)
    n = F.sum("n")
    spread = lambda v: F.sqrt(F.greatest(F.sum(f"q{v}") + F.sum(F.col("n") * F.col(f"m{v}") * F.col(f"m{v}")) - F.pow(F.sum(F.col("n") * F.col(f"m{v}")), F.lit(2.0)) / n, F.lit(0.0)) / n)
    return parts.groupBy(*keys, "axis", "band").agg(*(spread(v).alias(name) for v, name in zip("rpu", ("total", "by_path", "left"))))


def denoised(df: DataFrame, keys: list[str], order: str, axes: list[str], rate: str, gains: list[tuple], fps: float, soft: float = 80.0, gain: float = 1.0, slowest: float = 1.0) -> DataFrame:
    """keys, order and each of axes: the angle that takes the noise out of a motion's steps.

    Each axis' steps are scaled frequency by frequency (gains: shares at filters.GAIN_HZ), the less the faster the motion; the
    changes are summed before each row and kept from slowest Hz to nearly the highest frequency. An axis of a series is one task.
    """
    weight = gain / (1 + F.pow(F.col(rate) / soft, F.lit(2.0)))
    changes = {a: (lambda x, k=keep: filters.spectral_gain(x, fps, filters.GAIN_HZ, k) - x) for a, keep in zip(axes, gains)}
    d = filters.rewritten(df, keys, order, changes, [rate])
    sums = d.select(*keys, order, *(cumulative_before(weight * F.col(a), keys, order).alias(a) for a in axes))
    band = filters.butterworth("band", (slowest, fps / 2 * 0.992), fps)
    return filters.filtered_all(sums, keys, order, axes, lambda x: filters.zero_phase(x, band))
