"""Repair of a session's faulty stretches: targets beside or from pictures, guards, the strongest of repairs that overlap, and their timing."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quaternion as Q
from ..shared import kept
from . import asof, fits
from . import gates as G
from .groups import whole_groups

#: What can hold a repair back.
GUARDS = ("rate", "motion", "agreement", "quality")


@dataclass(frozen=True)
class Settings:
    """How a session is repaired; seconds, degrees and degrees a second. The defaults are fixed values of the balanced repair.

    guards: those of GUARDS that count; None: none for curves, all for bridges.
    """

    model: str = "curve"
    detail_kinds: tuple[str, ...] = ("gyro_fault", "micro_jitter")
    guards: tuple[str, ...] | None = None
    fade: float = 0.06
    margin: float = 0.04
    repair_margin: float = 0.10
    bridge_range: float = 2.0
    blend: float = 1.0
    most: float = 2.0
    context: float = 0.25
    points: int = 10
    degree: int = 3
    fit_scale: float = 0.25
    rate_limit: float = 5.0
    rate_power: float = 4.0
    agreement_free: float = 6.0
    agreement_scale: float = 10.0
    motion_start: float = 4.0
    motion_scale: float = 80.0
    veto_start: float = 110.0
    veto_rate: float = 3.5
    veto_strength: float = 2.0
    least_scale: float = 0.12


def repair_windows(events: DataFrame, rates: DataFrame, keys: list[str], dt: float, s: Settings) -> DataFrame:
    """keys, run, kind, start, end, lo, hi and fade: the window in which each event is repaired, within the recording.

    Curves reach `repair_margin` beyond the event, bridges `bridge_range` times its length about its middle. An error where an event's bounds are
    unknown, the wrong way round or beyond the frames.
    """
    ends = rates.groupBy(*keys).agg(((F.max("frame") + 2) * dt).alias("_end"))
    e = events.select(*keys, "run", "kind", F.col("lo").alias("start"), F.col("hi").alias("end")).join(F.broadcast(ends), keys, "left")
    right = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("_end") + 1e-9)
    e = e.withColumn("start", F.when(right, F.col("start")).otherwise(F.raise_error(F.lit("an event's bounds are not within the recording")).cast("double")))
    half = (F.col("end") - F.col("start")) / 2
    beyond = half * (s.bridge_range - 1) if s.model == "bridge" else F.lit(s.repair_margin)
    e = e.withColumn("lo", F.greatest(F.lit(0.0), F.col("start") - beyond)).withColumn("hi", F.least(F.col("_end"), F.col("end") + beyond))
    fade = s.fade + (s.margin if s.model == "bridge" else 0.0)
    return e.withColumn("fade", F.least(F.lit(fade), (F.col("hi") - F.col("lo")) / 2)).drop("_end")


def seen_rates(proposed: DataFrame, rates: DataFrame, windows: DataFrame, keys: list[str], pad: float, blend: float) -> DataFrame:
    """keys, run and predicted: the root mean square, in degrees a second, of what a repair adds to the motion from frame to frame.

    The repair is read at the frames within `pad` of its window, on lines between its samples and 0 beyond them; null with fewer than three of either.
    """
    part = lambda a: (F.col(f"v.{a}") * F.col("gate") * blend).alias(f"v{a}")
    told = proposed.select(*keys, "run", F.lit(0).alias("kind"), F.col("t").alias("at"), *map(part, "xyz"))
    near = windows.select(*keys, "run", (F.col("lo") - pad).alias("_from"), (F.col("hi") + pad).alias("_to"))
    none = [F.lit(None).cast("double").alias(f"v{a}") for a in "xyz"]
    frames = G.within(rates.select(*keys, "t"), near, keys, "t", "_from", "_to", 1.0).select(*keys, "run", F.lit(1).alias("kind"), F.col("t").alias("at"), *none)

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        kind, at, v = table["kind"].to_numpy(), table["at"].to_numpy(), np.column_stack([table[f"v{a}"].to_numpy() for a in "xyz"])
        out = []
        for i, j in zip(starts, np.append(starts[1:], len(at))):
            own, frame = kind[i:j] == 0, at[i:j][kind[i:j] == 1]
            if own.sum() < 3 or len(frame) < 3:
                out.append(None)
                continue
            read = np.column_stack([np.interp(frame, at[i:j][own], x, left=0.0, right=0.0) for x in v[i:j][own].T])
            out.append(float(np.sqrt((np.gradient(read, frame, axis=0) ** 2).sum(1).mean())))
        return table.select([*keys, "run"]).take(pa.array(starts)).append_column("predicted", pa.array(out, pa.float64()))

    types = ", ".join(f"`{k}` {dict(windows.dtypes)[k]}" for k in (*keys, "run"))
    return whole_groups(told.union(frames), [*keys, "run"], ["kind", "at"], run, f"{types}, predicted double")


def beside(rates: DataFrame, windows: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """keys, run, frames, motion and disagreement (degrees a second) of the sound frames within `reach` beside each window: those with
    confidence, told and seen, and in no event. Windows without such a frame have no row."""
    sound = rates.where(F.col("confidence") >= fits.CONFIDENCE).select(*keys, "t", *(f"{w}{a}" for w in "gs" for a in "xyz")).dropna()
    near = windows.select(*keys, "run", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), (F.col("lo") - reach).alias("_from"), (F.col("hi") + reach).alias("_to"))
    here = G.within(sound, near, keys, "t", "_from", "_to", 1.0).where((F.col("t") < F.col("_lo")) | (F.col("t") > F.col("_hi")))
    faulty = G.within(sound.select(*keys, "t"), windows.select(*keys, F.col("start").alias("_x"), F.col("end").alias("_y")), keys, "t", "_x", "_y", 1.0)
    here = here.join(faulty.select(*keys, "t").distinct(), [*keys, "t"], "left_anti")
    square = lambda f: F.sqrt(F.avg(sum((F.pow(f(a), F.lit(2.0)) for a in "xyz"), F.lit(0.0))))
    both = square(lambda a: (F.col(f"g{a}") + F.col(f"s{a}")) / 2)
    apart = square(lambda a: F.col(f"g{a}") - F.col(f"s{a}"))
    return here.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("frames"), both.alias("motion"), apart.alias("disagreement"))


def held_back(predicted: Column, disagreement: Column, motion: Column, s: Settings) -> Column:
    """What is left of a repair, between least_scale and 1: less where it would move fast, where told and seen disagree beside it, and where both the
    camera and the repair are fast."""
    over = lambda x, free: F.greatest(F.lit(0.0), x - free)
    fast = F.pow(1 + F.pow(predicted / s.rate_limit, F.lit(s.rate_power)), F.lit(-1 / s.rate_power))
    apart = 1 / F.sqrt(1 + F.pow(over(disagreement, s.agreement_free) / s.agreement_scale, F.lit(2.0)))
    together = 1 / F.sqrt(1 + F.pow(motion / s.motion_scale * over(predicted, s.motion_start) / s.motion_start, F.lit(2.0)))
    veto = F.exp(-s.veto_strength * over(motion, s.veto_start) / s.motion_scale * over(predicted, s.veto_rate) / s.veto_rate)
    return F.greatest(F.lit(s.least_scale), F.least(F.lit(1.0), fast * apart * together * veto))


def session_repair(samples: DataFrame, events: DataFrame, rates: DataFrame, maps: DataFrame, keys: list[str], dt: float, offset: float = 0.0, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(samples, repairs): samples with the attitude q turned where an event is repaired, by `applied` (degrees; null elsewhere).

    samples: keys, t (seconds, distinct in a series), q and any others; events: keys, run (a number, distinct in a series), lo, hi and kind; rates and maps: as
    fits.detail_targets() takes them. Events of detail_kinds are turned towards the detail that pictures show, others towards a curve through the
    clean samples beside them, or, as model "bridge", all towards the shortest arc. The way there is scaled by a gate of each window, by
    blend and by the guards; of repairs that overlap a sample takes that with the largest of these, the least run of equal ones; no turn
    goes beyond `most`. A series without events comes back as it is.

    repairs: keys, run, kind, lo, hi (the window), method (curve, detail or bridge), used (samples or rates), rms, drift, predicted, frames, motion,
    disagreement, scale, quality and gain.
    """
    s = settings
    if s.model not in ("curve", "bridge"):
        raise ValueError("model must be curve or bridge")
    guards = (() if s.model == "curve" else GUARDS) if s.guards is None else s.guards
    if set(guards) - set(GUARDS):
        raise ValueError(f"guards must be of {GUARDS}")
    windows = kept(repair_windows(events, rates, keys, dt, s))
    span = windows.select(*keys, "run", "lo", "hi", "kind")
    detail = F.coalesce(F.col("kind").isin(*s.detail_kinds), F.lit(False)) & F.lit(s.model == "curve")
    slim = samples.select(*keys, "t", "q")
    ends = kept(fits.span_ends(slim, span, keys))
    curve, curves = fits.context_curves(slim, span.where(~detail), windows.select(*keys, F.col("start").alias("lo"), F.col("end").alias("hi")), keys, s.context, s.points, s.degree, -1.0 if s.model == "bridge" else 4 * s.fit_scale, ends)
    shown, details = fits.detail_targets(slim, span.where(detail), rates, maps, keys, dt, offset, ends)
    targets = curve.union(shown).select(*keys, "run", "t", F.col("q").alias("_target"))
    told = curves.select(*keys, "run", "method", (F.coalesce("left", F.lit(0)) + F.coalesce("right", F.lit(0))).cast("long").alias("used"), "rms", F.lit(None).cast("double").alias("drift"))
    told = told.union(details.select(*keys, "run", "method", "used", F.lit(None).cast("double"), "drift"))
    inside = G.within(slim.withColumnRenamed("q", "_q"), windows.select(*keys, "run", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "fade"), keys, "t", "_lo", "_hi", 1.0)
    inside = inside.withColumn("gate", G.cosine_gate(F.col("t"), F.col("_lo"), F.col("_hi"), F.col("fade"))).where("gate > 0")
    proposed = kept(inside.join(targets, [*keys, "run", "t"]).select(*keys, "run", "t", "gate", Q.increment(F.col("_q"), F.col("_target")).alias("v")))

    d = windows.join(told, [*keys, "run"], "left").join(seen_rates(proposed, rates, windows, keys, max(2 * dt, s.margin), s.blend), [*keys, "run"], "left").join(beside(rates, windows, keys, s.context), [*keys, "run"], "left")
    d = d.fillna(0.0, ["predicted", "motion", "disagreement"]).fillna(0, ["frames"])
    if_on = lambda guard, name: F.col(name) if guard in guards else F.lit(0.0)
    d = d.withColumn("scale", held_back(if_on("rate", "predicted"), if_on("agreement", "disagreement"), if_on("motion", "motion"), s))
    quality = F.coalesce(F.pow(1 + F.pow(F.col("rms") / s.fit_scale, F.lit(4.0)), F.lit(-0.25)), F.lit(1.0)) if "quality" in guards else F.lit(1.0)
    d = kept(d.withColumn("quality", quality).withColumn("gain", s.blend * F.col("scale") * F.col("quality")))

    each = proposed.join(d.select(*keys, "run", "gain"), [*keys, "run"]).withColumn("_priority", F.col("gate") * F.col("gain")).where("_priority > 0")
    each = each.withColumn("_turn", Q.let(F.col("v"), lambda v: Q.vec(*(v[a] * F.col("_priority") for a in "xyz"))))
    best = G.strongest(each, [*keys, "t"], "_priority", "run", ["_turn"]).withColumn("applied", Q.soft_limited(F.col("_turn"), s.most)).drop("_turn")
    turned = F.when(F.col("applied").isNull(), F.col("q")).otherwise(Q.let(Q.from_rotation_vector(F.col("applied")), lambda m: Q.product(F.col("q"), m)))
    out = samples.join(best, [*keys, "t"], "left").withColumn("q", turned)
    return out, d.select(*keys, "run", "kind", "lo", "hi", "method", "used", "rms", "drift", "predicted", "frames", "motion", "disagreement", "scale", "quality", "gain")


def timed_variants(samples: DataFrame, shifts: DataFrame, keys: list[str], constant: float) -> DataFrame:
    """keys, frame, index, variant, t and q: each sample's attitude read later by nothing (none), by the median shift of its series (mean), by its own frame's
    (frame) and by a constant (manual). samples: keys, t (seconds), q, frame and index; shifts: keys, frame and shift_us, of which an unknown one is 0."""
    middle = shifts.groupBy(*keys).agg(F.median("shift_us").alias("_mid"))
    d = samples.select(*keys, "frame", "index", F.col("t").alias("_own")).join(shifts.select(*keys, "frame", "shift_us"), [*keys, "frame"], "left").join(F.broadcast(middle), keys, "left")
    by = {"none": F.lit(0.0), "mean": F.coalesce("_mid", F.lit(0.0)), "frame": F.coalesce(F.col("shift_us").cast("double"), F.lit(0.0)), "manual": F.lit(float(constant))}
    asked = d.withColumn("_v", F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), c.alias("us")) for n, c in by.items()))))
    asked = asked.select(*keys, "frame", "index", F.col("_v.variant").alias("variant"), "_own", (F.col("_own") + F.col("_v.us") / 1e6).alias("t"))
    met = asof.slerped(samples.select(*keys, "t", "q"), asked, keys, "t", "q", asof.STRETCH_S)
    return met.select(*keys, "frame", "index", "variant", F.col("_own").alias("t"), "q")


def frame_velocity(samples: DataFrame, frames: DataFrame, maps: DataFrame, keys: list[str], fps: float, offset: float = 0.0) -> DataFrame:
    """keys, frame, x, y, z: degrees a second from each frame to the next, read `offset` seconds after both, in the pictures' axes (maps: keys, p and s)."""
    asked = frames.select(*keys, "frame", F.explode(F.array(F.lit(0), F.lit(1))).alias("_end")).withColumn("t", (F.col("frame") + F.col("_end")) / fps + offset)
    at = asof.slerped(samples.select(*keys, "t", "q"), asked, keys, "t", "q", asof.STRETCH_S)
    both = fits.at_both_ends(at, [*keys, "frame"], "ab")
    raw = both.withColumn("v", Q.increment(F.col("b"), F.col("a"))).join(F.broadcast(maps.select(*keys, "p", "s")), keys)
    return raw.select(*keys, "frame", *((F.array("v.x", "v.y", "v.z")[F.col("p")[j]] * F.col("s")[j] * fps).alias(a) for j, a in enumerate("xyz")))
