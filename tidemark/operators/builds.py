"""Whole corrections: from samples and what is seen of a motion to samples that carry the corrected motion.

frames: keys, frame (from 0, dense), exposure (ms), ix, iy, iz (what is seen of the step to the next frame, degrees, in the
frame of what is told), curl (a second estimate of iz), points, sx, sy (a second estimate of ix and iy), hx, hy, hz and kx,
ky, kz (two estimates over `gap` frames, axes of the camera) and wpoints; all but keys and frame may be null. samples:
keys, t (microseconds), frame, index, q (struct of w, x, y, z) and inverted.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import quaternion as Q
from ..shared import stored
from . import adaptive, asof, corrections, filters, spikes
from .windows import cumulative_before, filled, framed, leaky_release, medians


@dataclass(frozen=True)
class Settings:
    """What a build depends on; degrees, seconds, milliseconds and Hz."""

    fps: float = 50.0
    gap: int = 5
    timing: str = "seen"  # or exposure: without the scan for a constant shift
    bias_ms: float = 0.0
    gain: float = 1.0
    soft_other: float = 80.0
    floor_hz: float = 4.0
    slowest_hz: float = 1.0
    event_least: float = 0.10
    event_model: str = "image"
    zero_net: bool = True
    unclear: float = 0.0
    estimator: str = "max"
    release_s: float = 1.5
    camera_max: float = 60.0
    baseline_s: float = 2.0

    @property
    def us(self) -> float:
        return 1e6 / self.fps

    @property
    def baseline(self) -> int:
        return max(3, round(self.baseline_s * self.fps) | 1)


# The frames that fits count (degrees a second), how many they need, and which gains are believed.
FIT_RATES, FIT_LEAST, JUNK_RATE = (20.0, 150.0), 200, 1000.0
SCAN_MS, SCAN_RATES, SCAN_END, CLEAR = 12, (30.0, 400.0), 8, 0.003
WINDOW_POINTS, WINDOW_RATES, CALM = 150, (40.0, 300.0), 20.0


def told_once(samples: DataFrame, frames: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both stored, as a build reads them many times, and plans are built and compiled anew for each of its steps."""
    return stored(samples.select(*keys, "t", "frame", "index", "q", "inverted"), "samples"), stored(frames, "told")


def _rate(s: Settings, v: Column) -> Column:
    return F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"]) * s.fps


#: Frames of a series that are read in one task.
STRETCH = 4096


def _with(df: DataFrame, each: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df with what each series has; a row for each series is sent to all tasks, so that no task gets a whole series."""
    return df.join(F.broadcast(each), keys, how)


def _turns(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rotation vectors from a to b as Q.increment() tells them."""
    (aw, ax, ay, az), (bw, bx, by, bz) = (a * [1, -1, -1, -1]).T, b.T
    w = aw * bw - ax * bx - ay * by - az * bz
    v = np.column_stack([aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw])
    n = np.sqrt((v * v).sum(1))
    k = np.degrees(np.where(n > 1e-12, 2 * np.arctan2(n, np.abs(w)) / np.where(n > 1e-12, n, 1.0), 2.0)) * np.where(w < 0, -1.0, 1.0)
    return v * k[:, None]


def measured_shift(samples: DataFrame, frames: DataFrame, keys: list[str], s: Settings) -> DataFrame:
    """keys, shift (ms), best, zero (root mean squares), clear and used: at which shift what is told of z is nearest to what is seen.

    25 shifts a millisecond apart around the frames' own instants, of frames of SCAN_RATES but the last SCAN_END; a parabola through the
    least and its neighbours refines it. Fewer than FIT_LEAST frames give no shift; a minimum less than CLEAR deep is not clear.
    Each task reads the shifts of a stretch of frames from the samples around it, and tells their sums about the stretch's own slope.
    """
    last = frames.groupBy(*keys).agg(F.max("frame").alias("_last"))
    told = _with(frames.select(*keys, "frame", "iz"), last, keys).where(F.col("iz").isNotNull() & (F.col("frame") <= F.col("_last") - SCAN_END))
    told = told.select(*keys, F.floor(F.col("frame") / STRETCH).alias("_b"), F.col("frame").cast("double").alias("_at"), "iz")
    size, beyond = STRETCH * s.us, SCAN_MS * 1000.0
    near = [F.floor((F.col("t") + sign * (beyond + 1)) / size) for sign in (-1, 1)]
    own = samples.select(*keys, F.explode(F.sequence(*near)).alias("_b"), "t", "q")
    # and from the nearest samples beyond them, however far off these are
    edges = told.select(*keys, "_b").distinct().select(*keys, "_b", F.explode(F.array(F.col("_b") * size - beyond, (F.col("_b") + 1) * size + beyond)).alias("t"))
    met = asof.segments(samples.select(*keys, "t", "q"), edges, keys, "t", "q", width=size).where("_t0 is not null")
    ring = met.select(*keys, "_b", F.explode(F.array(F.struct(F.col("_t0").alias("t"), F.col("_v0").alias("q")), F.struct(F.col("_t1").alias("t"), F.col("_v1").alias("q")))).alias("p")).select(*keys, "_b", "p.t", "p.q")
    rows = own.union(ring).select(*keys, "_b", F.col("t").cast("double").alias("_at"), *(F.col(f"q.{k}").alias(k) for k in Q.PARTS), F.lit(None).cast("double").alias("iz"))
    rows = rows.unionByName(told.select(*keys, "_b", "_at", *(F.lit(None).cast("double").alias(k) for k in Q.PARTS), F.col("iz").cast("double").alias("iz")))
    double, names, lists = T.DoubleType(), ("_sz", "_si", "_szz", "_szi", "_own"), ("_ee", "_ez", "_zz")
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("_n", T.LongType()), *(T.StructField(n, double) for n in names), *(T.StructField(n, T.ArrayType(double)) for n in lists)])

    def part(table: pa.Table) -> pa.Table:
        seen = table["iz"].is_valid().to_numpy()
        at = table["_at"].to_numpy()
        ts, first = np.unique(at[~seen], return_index=True)
        out = table.slice(0, 1 if seen.any() and len(ts) > 1 else 0).select(keys)
        n, sums, found = 0, [0.0] * 5, [[0.0] * (2 * SCAN_MS + 1)] * 3
        if out.num_rows:
            qs = np.column_stack([table[k].to_numpy() for k in Q.PARTS])[~seen][first]
            frame, iz = at[seen], table["iz"].to_numpy()[seen]
            turn = lambda f, ms: _turns(asof.read_rotations(ts, qs, f * s.us + ms * 1000.0), asof.read_rotations(ts, qs, (f + 1) * s.us + ms * 1000.0))
            v = turn(frame, 0)
            rate = np.sqrt((v * v).sum(1)) * s.fps
            used = (rate > SCAN_RATES[0]) & (rate < SCAN_RATES[1])
            frame, iz, z = frame[used], iz[used], v[used, 2]
            n, zz = len(frame), float(z @ z)
            g = float(z @ iz) / zz if zz > 0 else 0.0
            sums = [float(z.sum()), float(iz.sum()), zz, float(z @ iz), g]
            if n:
                shifted = [turn(frame, ms)[:, 2] for ms in range(-SCAN_MS, SCAN_MS + 1)]
                left = [iz - g * x for x in shifted]
                found = [[float(e @ e) for e in left], [float(e @ x) for e, x in zip(left, shifted)], [float(x @ x) for x in shifted]]
        fields = [pa.array([x] * out.num_rows, pa.int64() if i == 0 else pa.float64()) for i, x in enumerate([n, *sums])] + [pa.array([x] * out.num_rows, pa.list_(pa.float64())) for x in found]
        for name, x in zip(("_n", *names, *lists), fields):
            out = out.append_column(name, x)
        return out

    parts = rows.groupBy(*keys, "_b").applyInArrow(part, schema)
    total = [F.sum(c) for c in ("_szi", "_sz", "_si", "_n", "_szz")]
    slope = F.try_divide(total[0] - total[1] * total[2] / total[3], total[4] - total[1] * total[1] / total[3])
    fit = parts.where("_n > 0").groupBy(*keys).agg(slope.alias("_g"), F.sum("_n").alias("used")).where(F.col("used") >= FIT_LEAST)
    each = _with(parts.where("_n > 0"), fit, keys).withColumn("_d", F.col("_g") - F.col("_own"))
    each = each.select(*keys, "used", "_d", F.posexplode(F.arrays_zip(*lists)).alias("_k", "_p"))
    square = F.sum(F.col("_p._ee") - 2 * F.col("_d") * F.col("_p._ez") + F.col("_d") * F.col("_d") * F.col("_p._zz"))
    cost = each.groupBy(*keys, (F.col("_k") - SCAN_MS).alias("ms")).agg(F.sqrt(F.greatest(square, F.lit(0.0)) / F.max("used")).alias("r"), F.max("used").alias("used"))
    by = Window.partitionBy(*keys).orderBy("ms")
    cost = cost.select("*", F.lag("r").over(by).alias("a"), F.lead("r").over(by).alias("b"))
    best = cost.groupBy(*keys).agg(F.min(F.struct("r", "ms", "a", "b")).alias("m"), F.max(F.when(F.col("ms") == 0, F.col("r"))).alias("zero"), F.max("used").alias("used"))
    den = F.col("m.a") - 2 * F.col("m.r") + F.col("m.b")
    bend = F.coalesce(F.when(den > 0, 0.5 * (F.col("m.a") - F.col("m.b")) / den), F.lit(0.0))
    clear = (F.col("zero") > 0) & ((F.col("zero") - F.col("m.r")) / F.col("zero") >= CLEAR)
    return best.select(*keys, (F.col("m.ms") + bend).alias("shift"), F.col("m.r").alias("best"), "zero", F.coalesce(clear, F.lit(False)).alias("clear"), "used")


def timed(samples: DataFrame, frames: DataFrame, keys: list[str], s: Settings) -> DataFrame:
    """frames with delta (microseconds by which each is read elsewhere): half of what its exposure is below the median, and the clear constant."""
    e = frames.withColumn("_e", filled("exposure", keys, "frame")) if "exposure" in frames.columns else frames.withColumn("_e", F.lit(0.0))
    e = _with(e, e.groupBy(*keys).agg(F.percentile("_e", F.lit(0.5)).alias("_mid")), keys)
    e = e.withColumn("_var", F.coalesce((F.col("_mid") - F.col("_e")) / 2, F.lit(0.0))).drop("_mid")
    if s.timing == "exposure":
        return e.withColumn("delta", (F.col("_var") + s.bias_ms) * 1000.0).drop("_e", "_var")
    if s.timing != "seen":
        raise ValueError("timing is seen or exposure")
    # a row for each series, stored: what follows is planned without the scan
    constant = stored(measured_shift(samples, frames, keys, s).select(*keys, F.when(F.col("clear"), F.col("shift")).otherwise(0.0).alias("_const")), "shifts")
    e = _with(e, constant, keys, "left")
    return e.withColumn("delta", (F.coalesce("_const", F.lit(0.0)) + F.col("_var") + s.bias_ms) * 1000.0).drop("_e", "_var", "_const")


def stepped(samples: DataFrame, frames: DataFrame, keys: list[str], s: Settings) -> DataFrame:
    """frames (with delta) and q, tx, ty, tz (where the motion is over gap frames), x, y, z (its step), rate, valid and camera (the rate's median of five)."""
    ends = frames.groupBy(*keys).agg(F.max_by(F.struct("frame", "delta"), "frame").alias("e")).select(*keys, (F.col("e.frame") + 1).alias("frame"), F.col("e.delta").alias("delta"))
    grid = frames.unionByName(ends, allowMissingColumns=True).withColumn("t", F.col("frame") * s.us + F.col("delta"))
    span = samples.groupBy(*keys).agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    at = asof.slerped(samples.select(*keys, "t", "q"), grid, keys, "t", "q", STRETCH * s.us)
    ahead = lambda c, k=1: lambda _, w: F.lead(c, k).over(w)
    at = framed(at, keys, "frame", 0, max(1, s.gap), {"_n": ahead("q"), "_tn": ahead("t"), "_far": ahead("q", s.gap)})
    step, over = (F.when(F.col(c).isNotNull(), Q.increment(F.col("q"), F.col(c))) for c in ("_n", "_far"))
    at = _with(at.withColumn("step", step).where("step is not null").withColumn("_over", over), span, keys).withColumn("_r", _rate(s, F.col("step")))
    valid = (F.col("t") >= F.col("_lo")) & (F.col("_tn") <= F.col("_hi")) & (F.col("_r") < JUNK_RATE)
    parts = [F.col(f"step.{a}").alias(a) for a in "xyz"] + [F.col(f"_over.{a}").alias(f"t{a}") for a in "xyz"]
    d = at.select(*frames.columns, *parts, valid.alias("valid"), F.when(valid, F.col("_r")).otherwise(1e6).alias("rate"))
    return medians(d, keys, "frame", 5, {"camera": "rate"})


def _gains(df: DataFrame, keys: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """keys and, for each name of pairs, the slope of seen over told, g_<name>, and their correlation, corr_<name>, of frames of
    FIT_RATES: 1 and null with fewer than FIT_LEAST."""
    out = []
    for name, (told, seen) in pairs.items():
        use = (F.col("rate") > FIT_RATES[0]) & (F.col("rate") < FIT_RATES[1]) & F.col(told).isNotNull() & F.col(seen).isNotNull()
        a, b = F.when(use, F.col(told)), F.when(use, F.col(seen))
        enough = F.count(a) >= FIT_LEAST
        out += [F.when(enough, F.regr_slope(b, a)).otherwise(1.0).alias(f"g_{name}"), F.when(enough, F.corr(a, b)).alias(f"corr_{name}")]
    return df.groupBy(*keys).agg(*out)


def _believed(name: str, least: float, signed: bool = False) -> Column:
    g = F.abs(f"g_{name}") if signed else F.col(f"g_{name}")
    return F.coalesce((F.col(f"corr_{name}") >= least) & (g > 0.3) & (g < 3.0), F.lit(False))


def _kept_of(df: DataFrame, keys: list[str], told: str, seen: str, s: Settings) -> DataFrame:
    """keys and keep: the shares of filters.GAIN_HZ of a series whose calm runs tell them."""
    found = filters.spectral_keep(df, keys, "frame", told, seen, F.col("rate") < CALM, s.fps, s.floor_hz)
    return found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("hz", "keep"))).alias("_l")).select(*keys, F.col("_l.keep").alias("keep"))


def quiet_other(df: DataFrame, keys: list[str], s: Settings) -> DataFrame:
    """keys, frame and px, py: the angles that take the noise above floor_hz out of x and y; df: x and y without spikes, ix, iy, rate and valid.

    The shares that are kept are those of what is seen over what is told in calm runs, where the two go together (0.8), else the fixed ones.
    """
    d = _with(df, _gains(df, keys, {a: (a, f"i{a}") for a in "xy"}), keys)
    fixed = [1.0 if hz < s.floor_hz else k for hz, k in zip(filters.GAIN_HZ, filters.GAIN_OTHER)]
    each = d.select(*keys).distinct()
    for a in "xy":
        calm = d.where(F.col(f"corr_{a}") >= 0.8).select(*keys, "frame", "rate", F.col(a), (F.col(f"i{a}") / F.col(f"g_{a}")).alias("_seen"))
        each = _with(each, _kept_of(calm, keys, a, "_seen", s).withColumnRenamed("keep", f"_s_{a}"), keys, "left")
    each = stored(each, "shares")  # a row for each series
    scale = lambda x, keep: filters.spectral_gain(x, s.fps, filters.GAIN_HZ, tuple(fixed if keep is None else keep), 100)
    scaled = filters.rewritten(d.select(*keys, "frame", *(F.col(a).alias(f"_s_{a}") for a in "xy")), keys, "frame", {f"_s_{a}": scale for a in "xy"}, each=each)
    out = d.select(*keys, "frame", "x", "y", "rate", "valid").join(scaled, [*keys, "frame"])
    weight = F.when(F.col("valid"), s.gain / (1 + F.pow(F.col("rate") / s.soft_other, F.lit(2.0)))).otherwise(0.0)
    sums = out.select(*keys, "frame", *(cumulative_before(weight * (F.col(f"_s_{a}") - F.col(a)), keys, "frame").alias(f"p{a}") for a in "xy"))
    band = filters.butterworth("band", (s.slowest_hz, s.fps / 2 * 0.992), s.fps)
    return filters.filtered_all(sums, keys, "frame", ["px", "py"], lambda x: filters.zero_phase(x, band))


def window_readings(d: DataFrame, keys: list[str], s: Settings) -> DataFrame:
    """keys, frame, gx, gy (seen less told a frame, by the windows that hold it) and reliable.

    Two estimates over gap frames, brought to the told axes by their signed order, are held against the motion over the gap; see
    corrections.window_disagreement. A frame has the mean of the windows that hold it, and is reliable if 60 % of them are.
    """
    seen, told = [[f"{n}{a}" for a in "xyz"] for n in "hk"], ["tx", "ty", "tz"]
    ok = reduce(Column.__and__, [F.col(c).isNotNull() for c in (*seen[0], *seen[1], *told)]) & (F.col("wpoints") >= WINDOW_POINTS)
    rate = F.sqrt(reduce(Column.__add__, [F.col(t) * F.col(t) for t in told])) / s.gap * s.fps
    d = d.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    maps = corrections.axis_map(d, keys, told, seen[0], F.col("_ok") & (rate > WINDOW_RATES[0]) & (rate < WINDOW_RATES[1]))
    d = _with(d, maps.select(*keys, "p", "s"), keys)
    turned = [F.array(*(F.col(c) for c in n))[F.col("p")[j]] * F.col("s")[j] for n in seen for j in range(3)]
    d = d.select(*keys, "frame", *told, "_ok", "valid", *(c.alias(n) for c, n in zip(turned, (*seen[0], *seen[1]))))
    found = corrections.window_disagreement(d, keys, "frame", told, *seen, F.col("_ok"), s.baseline, s.estimator)
    d = d.select(*keys, "frame", "valid").join(found, [*keys, "frame"])
    full = F.col("d_tx").isNotNull() & F.col("d_ty").isNotNull() & F.col("d_tz").isNotNull()
    mean = lambda a: lambda rows, _: F.avg(F.when(full, F.col(f"d_{a}") / s.gap)).over(rows)
    count = {"_n": lambda rows, _: F.count_if(full).over(rows), "_rel": lambda rows, _: F.count_if(full & F.col("reliable")).over(rows)}
    out = framed(d, keys, "frame", s.gap - 1, 0, {"gx": mean("tx"), "gy": mean("ty"), **count})
    return out.select(*keys, "frame", "gx", "gy", ((F.col("_n") > 0) & (F.col("_rel") >= F.greatest(F.lit(1.0), 0.6 * F.col("_n"))) & F.col("valid")).alias("reliable"))


def main_build(samples: DataFrame, frames: DataFrame, keys: list[str], s: Settings = Settings(), free: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, frames, events): the whole correction, each stored, so that later steps start from it.

    samples: keys, frame, index, q (in the camera's frame), stored (in the sensor's, with its sign) and base (q without correction).
    frames: keys, frame, delta, rate, valid, spike, roll_gate, the angles of each part - roll, px, py (noise), ex, ey (events), jx,
    jy (spikes) - and theta_x, theta_y, theta_z in degrees. events: those of corrections.event_segments with what checks them.
    free: spans (keys, lo, hi in frames) whose events may turn for good.
    """
    samples, frames = told_once(samples, frames, keys)
    d = stored(stepped(samples, stored(timed(samples, frames, keys, s), "timed"), keys, s), "steps")
    pairs = {**{a: (a, f"i{a}") for a in "xyz"}, "sx": ("x", "sx"), "sy": ("y", "sy")}
    d = _with(d, _gains(d, keys, pairs), keys)
    off = lambda a: F.when(F.col("valid"), F.col(f"i{a}") / F.when(_believed(a, 0.6), F.col(f"g_{a}")).otherwise(1.0) - F.col(a))
    fit = F.when(_believed("sx", 0.5, True), 1).otherwise(0) + F.when(_believed("sy", 0.5, True), 1).otherwise(0)
    d = d.select("*", *(off(a).alias(f"f{a}") for a in "xy"), *(F.when(F.col("valid"), F.col(f"i{a}") - F.col(a)).alias(f"r{a}") for a in "xy"), (fit == 2).alias("witnessed"))
    d = d.select("*", *(F.when(F.col("valid"), F.col(f"s{a}") / F.when(_believed(f"s{a}", 0.5, True), F.col(f"g_s{a}")).otherwise(1.0) - F.col(a)).alias(f"w{a}") for a in "xy"))
    d = spikes.unconfirmed(d, keys, "frame", ["x", "y"], ["fx", "fy"], "rate", second=["rx", "ry"], camera="camera", camera_max=s.camera_max, valid="valid").drop("r_x", "r_y", "jump")
    calm = [F.when(F.col("valid"), F.col(a) + F.col(f"c_{a}")).otherwise(0.0) for a in "xy"]
    d = stored(d.select("*", *(c.alias(f"q{a}") for c, a in zip(calm, "xy")), *((F.col(f"f{a}") - F.col(f"c_{a}")).alias(f"n{a}") for a in "xy")), "spikes")

    roll = adaptive.roll_correction(d.select(*keys, "frame", F.col("z").alias("told"), F.col("iz").alias("seen"), "curl", "points", "rate", "valid"), keys, "frame", s.fps)
    plain = d.select(*keys, "frame", F.col("qx").alias("x"), F.col("qy").alias("y"), "ix", "iy", "sx", "sy", "rate", "valid", "camera", "spike", "contaminated", "nx", "ny", "wx", "wy", "witnessed")
    noise = quiet_other(plain, keys, s)
    rows = stored(plain.join(window_readings(d, keys, s), [*keys, "frame"]), "readings")
    second = s.fps
    segments, events = corrections.event_segments(
        rows, keys, "frame", ["gx", "gy"], ["x", "y"], "reliable", "rate", s.event_least, s.baseline, min_rows=max(2, round(0.1 * second)), merge=max(2, round(0.12 * second)),
        model=s.event_model, context=max(3, round(0.2 * second)), gain=s.gain, fine=["nx", "ny"], witness=["wx", "wy"], witnessed="witnessed", camera="camera", camera_max=s.camera_max, zero_net=s.zero_net, free=free, fps=second, keep=lambda met: stored(met, "windows"),
    )
    segments, events = stored(segments, "segments"), stored(events, "events")
    # what the second estimate says of the de-spiked motion, where it goes with it
    gains = _gains(plain, keys, {"sx": ("x", "sx"), "sy": ("y", "sy")})
    also = _with(plain, gains, keys).select(*keys, "frame", *(F.when(F.col(f"corr_s{a}") >= 0.5, F.col(f"s{a}") / F.col(f"g_s{a}") - F.col(a)).alias(f"_v{a}") for a in "xy"))
    full = also.select(*keys, "frame", *(filled(f"_v{a}", keys, "frame").alias(f"_v{a}") for a in "xy"))
    full = medians(full, keys, "frame", s.baseline, {"_mx": "_vx", "_my": "_vy"}).select(*keys, "frame", *((F.col(f"_v{a}") - F.col(f"_m{a}")).alias(f"_v{a}") for a in "xy"))
    checks = corrections.event_checks(segments, full, keys, "frame", ["x", "y"], ["_vx", "_vy"])
    changed, events = corrections.weighted_events(segments, events, checks, keys, "frame", ["x", "y"], s.unclear)
    inside = segments.select(*keys, "frame").distinct().withColumn("_in", F.lit(True))
    e = d.select(*keys, "frame", "spike", *(F.col(f"c_{a}").alias(f"_j{a}") for a in "xy")).join(changed, [*keys, "frame"], "left").join(inside, [*keys, "frame"], "left")
    w = Window.partitionBy(*keys).orderBy("frame")
    before = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0.0))
    e = e.withColumn("_in", F.coalesce("_in", F.lit(False))).select("*", *(before(F.coalesce(f"c_{a}", F.lit(0.0))).alias(f"_e{a}") for a in "xy"), *(before(F.col(f"_j{a}") * s.gain).alias(f"_k{a}") for a in "xy"))
    fade = float(np.exp(-1 / (s.release_s * s.fps)))
    for step, held, name in (("_ex", "_in", "ex"), ("_ey", "_in", "ey"), ("_kx", "spike", "jx"), ("_ky", "spike", "jy")):
        e = leaky_release(e, keys, "frame", step, held, fade, name)
    out = d.select(*keys, "frame", "delta", "rate", "valid", "spike").join(e.select(*keys, "frame", "ex", "ey", "jx", "jy"), [*keys, "frame"]).join(noise, [*keys, "frame"])
    out = out.join(roll.select(*keys, "frame", (F.col("theta") * s.gain).alias("roll"), F.col("gate").alias("roll_gate")), [*keys, "frame"])
    theta = [F.col(f"p{a}") + F.col(f"e{a}") + F.col(f"j{a}") for a in "xy"]
    out = stored(out.select("*", theta[0].alias("theta_x"), theta[1].alias("theta_y"), F.col("roll").alias("theta_z")), "frames")
    return corrected(samples, out, keys, s), out, events


def corrected(samples: DataFrame, frames: DataFrame, keys: list[str], s: Settings) -> DataFrame:
    """keys, frame, index, q, stored and base: samples read at their frame's delta and turned by theta on lines between frames."""
    axes = ["theta_x", "theta_y", "theta_z"]
    ahead = {f"_n_{a}": (lambda _, w, a=a: F.coalesce(F.lead(a).over(w), F.col(a))) for a in axes}
    lines = framed(frames.select(*keys, "frame", *axes), keys, "frame", 0, 1, ahead).withColumnRenamed("frame", "_k")
    last = frames.groupBy(*keys).agg(F.max("frame").alias("_last"))
    at = _with(samples.join(frames.select(*keys, "frame", "delta"), [*keys, "frame"]), last, keys)
    place = F.greatest(F.lit(0.0), F.least(F.col("t") / s.us, F.col("_last").cast("double")))
    at = at.withColumn("_p", place).withColumn("_k", F.floor("_p").cast("int")).join(lines, [*keys, "_k"])
    theta = [F.col(a) + (F.col(f"_n_{a}") - F.col(a)) * (F.col("_p") - F.col("_k")) for a in axes]
    asked = at.select(*keys, "frame", "index", "inverted", (F.col("t") + F.col("delta")).alias("t"), Q.vec(*theta).alias("_v"))
    base = asof.slerped(samples.select(*keys, "t", "q"), asked, keys, "t", "q", STRETCH * s.us)
    turned = Q.let(Q.product(F.col("q"), Q.from_rotation_vector(F.col("_v"))), Q.normalized)
    out = base.select(*keys, "frame", "index", "inverted", turned.alias("q"), F.col("q").alias("base"))
    signed = F.when(F.col("inverted"), Q.negate(F.col("q"))).otherwise(F.col("q"))
    stored = Q.let(Q.to_sensor(F.col("_signed")), Q.normalized)
    return out.withColumn("_signed", signed).select(*keys, "frame", "index", "q", stored.alias("stored"), "base")


def _basis(axis: tuple[float, float, float]) -> list[np.ndarray]:
    """The axis at length one, and two across it."""
    u = np.asarray(axis, float) / np.linalg.norm(axis)
    a = np.array([1.0, 0, 0]) - u * u[0]
    if np.linalg.norm(a) < 1e-9:
        raise ValueError("the axis may not be the first one")
    a /= np.linalg.norm(a)
    return [u, a, np.cross(u, a)]


def _along(axis: np.ndarray) -> Column:
    return reduce(Column.__add__, [F.col(a) * float(v) for a, v in zip("xyz", axis)])


def _turned(d: DataFrame, keys: list[str], angles: dict[str, np.ndarray]) -> DataFrame:
    """d's frames with theta: angles about axes, nulls as zero."""
    theta = [reduce(Column.__add__, [F.coalesce(F.col(n), F.lit(0.0)) * float(axis[j]) for n, axis in angles.items()]) for j in range(3)]
    return d.select(*keys, "frame", "delta", *angles, *(t.alias(f"theta_{a}") for t, a in zip(theta, "xyz")))


def noise_build(samples: DataFrame, frames: DataFrame, keys: list[str], s: Settings = Settings(timing="exposure"), axis: tuple[float, float, float] = (0, 0, 1), three: bool = True) -> tuple[DataFrame, DataFrame]:
    """(samples, frames) without what the fixed shares take for noise in the steps about the axis, and (three) the two across it; nothing that is seen is needed."""
    samples, frames = told_once(samples, frames, keys)
    d = stored(stepped(samples, stored(timed(samples, frames, keys, s), "timed"), keys, s), "steps")
    axes = _basis(axis)[: 3 if three else 1]
    names = ["about", "across", "along"][: len(axes)]
    steps = d.select(*keys, "frame", "rate", *(_along(a).alias(n) for n, a in zip(names, axes)))
    angles = adaptive.denoised(steps, keys, "frame", names, "rate", [filters.GAIN_ROLL, filters.GAIN_OTHER, filters.GAIN_OTHER][: len(axes)], s.fps, s.soft_other, s.gain, s.slowest_hz)
    out = stored(_turned(d.select(*keys, "frame", "delta").join(angles, [*keys, "frame"]), keys, dict(zip(names, axes))), "frames")
    return corrected(samples, out, keys, s), out


def roll_build(samples: DataFrame, frames: DataFrame, keys: list[str], s: Settings = Settings(timing="exposure"), axis: tuple[float, float, float] = (0, 0, 1), soft: float = 40.0, low: float = 4.0, high: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(samples, frames) whose turn about the axis is what iz shows of it, between two frequencies, the less the faster the motion."""
    samples, frames = told_once(samples, frames, keys)
    d = stored(stepped(samples, stored(timed(samples, frames, keys, s), "timed"), keys, s), "steps")
    (u,) = _basis(axis)[:1]
    off = F.coalesce((F.col("iz") - _along(u)) / (1 + F.pow(F.col("rate") / soft, F.lit(2.0))), F.lit(0.0)) * s.gain
    band = filters.butterworth("band", (low, min(high or s.fps / 2 * 0.992, s.fps / 2 * 0.999)), s.fps)
    sums = d.select(*keys, "frame", cumulative_before(off, keys, "frame").alias("about"))
    angle = filters.filtered_all(sums, keys, "frame", ["about"], lambda x: filters.zero_phase(x, band))
    out = stored(_turned(d.select(*keys, "frame", "delta").join(angle, [*keys, "frame"]), keys, {"about": u}), "frames")
    return corrected(samples, out, keys, s), out


def burst_build(samples: DataFrame, frames: DataFrame, keys: list[str], s: Settings = Settings(timing="exposure"), axis: tuple[float, float, float] = (0, 0, 1), least: float = 0.2, soft: float = 40.0, rate_max: float = 150.0, margin: int = 8, gap_rows: int = 5) -> tuple[DataFrame, DataFrame]:
    """(samples, frames) turned about the axis in bursts only: see corrections.burst_angle. What is told of a burst is read at the frames' own instants."""
    samples, frames = told_once(samples, frames, keys)
    own = stored(stepped(samples, frames.withColumn("delta", F.lit(0.0)), keys, s), "steps")
    (u,) = _basis(axis)[:1]
    gap = own.select(*keys, "frame", "rate", (F.col("iz") - _along(u)).alias("gap"))
    angle = corrections.burst_angle(gap, keys, "frame", "gap", "rate", least, soft, rate_max, margin, gap_rows).select(*keys, "frame", (F.col("angle") * s.gain).alias("about"))
    moved = timed(samples, frames, keys, s).select(*keys, "frame", "delta")
    out = stored(_turned(moved.join(angle, [*keys, "frame"], "left"), keys, {"about": u}), "frames")
    return corrected(samples, out, keys, s), out


def align_build(samples: DataFrame, frames: DataFrame, keys: list[str], shift: str, s: Settings = Settings(), every: bool = True, extra_ms: float = 0.0) -> DataFrame:
    """Samples read at their frame's shift (a column of frames, microseconds; every: that of each frame, else the median of all) and extra_ms later."""
    own = F.col(shift)
    if not every:
        frames, own = _with(frames, frames.groupBy(*keys).agg(F.percentile(shift, F.lit(0.5)).alias("_mid")), keys), F.col("_mid")
    still = frames.select(*keys, "frame", (own + extra_ms * 1000.0).alias("delta"), *(F.lit(0.0).alias(f"theta_{a}") for a in "xyz"))
    return corrected(samples, still, keys, s)


def control(samples: DataFrame, frames: DataFrame, keys: list[str], s: Settings = Settings()) -> DataFrame:
    """What a build would give without any correction but the timing."""
    return align_build(samples, timed(samples, frames, keys, s), keys, "delta", s)
