"""Queries over robust fits: rays and points made from embeddings, and the telemetry of plans/builds.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lens
from ..functions import quaternion as Q
from ..operators import fits, session_repair
from ..operators import windows as W
from ..shared import kept, stored
from .builds import FPS, telemetry
from .series import K
from .views import flat, r6, s6, table

FOCAL, CENTRE, LENS = 1400.0, (1920.0, 1440.0), (0.15, 0.13, -0.05, 0.004)
GROUP = ["label", "part"]


def _points(spark, sf_dir):
    e = F.col("embedding")
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", "label", F.floor(F.col("vec_id") / 500).alias("part"), *(e[k].cast("double").alias(f"e{k}") for k in range(6)))


def m07_lens_lift(spark, sf_dir):
    """Pixels of a fisheye picture on the plane at distance one, and as rays; null where no angle in front of the lens fits."""
    p = _points(spark, sf_dir).withColumn("p", lens.lifted(CENTRE[0] + 4000 * F.col("e0"), CENTRE[1] + 4000 * F.col("e1"), FOCAL, CENTRE, LENS)).withColumn("r", lens.ray(F.col("p")))
    return p.select("vec_id", *(F.round(F.col(f"p.{k}"), 5).alias(k) for k in "xy"), *(r6(F.col(f"r.{k}")).alias(f"r{k}") for k in "xyz"))


def _angle(d: str) -> str:
    value = "a * (1 + a*a * (0.15::DOUBLE + a*a * (0.13::DOUBLE + a*a * (-0.05::DOUBLE + a*a * 0.004::DOUBLE))))"
    slope = "(1 + a*a * (0.45::DOUBLE + a*a * (0.65::DOUBLE + a*a * (-0.35::DOUBLE + a*a * 0.036::DOUBLE))))"
    return f"list_reduce(list_prepend(least({d}, pi() / 2), list_transform(range(12), lambda i: i::DOUBLE)), lambda a, i: a - ({value} - {d}) / {slope})"


M07 = f"""WITH p AS (SELECT vec_id, (1920 + 4000 * embedding[1]::DOUBLE - 1920) / 1400 AS u, (1440 + 4000 * embedding[2]::DOUBLE - 1440) / 1400 AS v FROM embeddings),
    d AS (SELECT *, sqrt(u*u + v*v) AS d FROM p), a AS (SELECT *, {_angle('d')} AS a FROM d),
    l AS (SELECT vec_id, CASE WHEN a >= 0 AND a < pi() / 2 AND abs(a * (1 + a*a * (0.15 + a*a * (0.13 + a*a * (-0.05 + a*a * 0.004)))) - d) < 1e-9 THEN CASE WHEN d > 1e-12 THEN tan(a) / d ELSE 1.0 END END AS k, u, v FROM a)
    SELECT vec_id, round(u*k, 5) AS x, round(v*k, 5) AS y, {s6('u*k / sqrt(u*k*u*k + v*k*v*k + 1)')} AS rx, {s6('v*k / sqrt(u*k*u*k + v*k*v*k + 1)')} AS ry, {s6('1 / sqrt(u*k*u*k + v*k*v*k + 1)')} AS rz FROM l"""


def m03_rotation_fit(spark, sf_dir):
    """The rotation between two sets of rays, one in ten of which belongs to something else."""
    p = _points(spark, sf_dir)
    turn = Q.from_rotation_vector(Q.vec(F.col("label") * 0.3 + 0.5, F.lit(-0.8), F.col("part") * 0.01 + 0.2))
    ray = lambda x, y: Q.let(F.sqrt(x * x + y * y + 1), lambda n: Q.quat(F.lit(0.0), x / n, y / n, 1 / n))
    a = ray(2 * F.col("e0"), 2 * F.col("e1"))
    p = p.withColumn("a", a).withColumn("q", turn).withColumn("b", Q.product(Q.product(F.col("q"), F.col("a")), Q.conjugate(F.col("q"))))
    other = ray(2 * F.col("e2"), 2 * F.col("e3"))
    p = p.withColumn("b", F.when(F.col("vec_id") % 10 == 0, other).otherwise(F.col("b")))
    slim = p.select(*GROUP, *(F.col(f"a.{k}").alias(f"a{k}") for k in "xyz"), *((F.col(f"b.{k}") + F.col(n) * 1e-4).alias(f"b{k}") for k, n in zip("xyz", ("e4", "e5", "e3"))))
    found = fits.rotation_fit(slim, GROUP, ["ax", "ay", "az"], ["bx", "by", "bz"])
    return found.select(*GROUP, *(r6(F.col(k)).alias(k) for k in ("x", "y", "z", "residual")), "n")


def m02_affine_flow(spark, sf_dir):
    """The roll, growth, shear and shift of the points between two pictures, some of which move otherwise."""
    p = _points(spark, sf_dir)
    x, y = 900 * F.col("e0"), 700 * F.col("e1")
    roll, growth, shear = 0.004 + F.col("label") * 0.001, 0.002, 0.0005
    vx = x * (growth + shear) - y * roll + 1.5 + F.when(F.col("vec_id") % 9 == 0, 40.0).otherwise(F.col("e2") * 0.05)
    vy = x * roll + y * (growth - shear) - 0.75 + F.col("e3") * 0.05
    slim = p.select(*GROUP, (x + 960).alias("ax"), (y + 720).alias("ay"), (x + 960 + vx).alias("bx"), (y + 720 + vy).alias("by"))
    found = fits.affine_flow(slim, GROUP, ("ax", "ay"), ("bx", "by"), (960.0, 720.0), 700.0)
    return found.select(*GROUP, *(r6(F.col(k)).alias(k) for k in ("roll", "growth", "shear", "shift_x", "shift_y")), "n")


def _seconds(spark, sf_dir):
    samples, frames = telemetry(spark, sf_dir)
    return samples.withColumn("t", F.col("t") / 1e6), frames


def _gaps(samples):
    """A gap of 0.2 s in every two seconds."""
    ends = samples.groupBy(*K).agg(F.max("t").alias("end")).where("end >= 4")
    runs = ends.select(*K, F.explode(F.sequence(F.lit(1), F.floor(F.col("end") / 2 - 1).cast("int"))).alias("run"))
    return runs.select(*K, "run", (F.col("run") * 2.0 + 0.301).alias("lo"), (F.col("run") * 2.0 + 0.501).alias("hi"))


def c10_context_curve(spark, sf_dir):
    """Attitudes across gaps from the samples beside them; every fifth gap has another one close by, whose samples don't count."""
    samples, _ = _seconds(spark, sf_dir)
    gaps = _gaps(samples)
    excluded = gaps.select(*K, "lo", "hi").union(gaps.where("run % 5 = 0").select(*K, F.col("lo") - 0.1, F.col("lo") - 0.01))
    found, _ = fits.context_curves(samples, gaps, excluded, K)
    return found.select(*K, "run", r6(F.col("t")).alias("t"), *flat(F.col("q"), "q"))


def c10_curves(spark, sf_dir):
    """What each gap's curve rests on."""
    samples, _ = _seconds(spark, sf_dir)
    gaps = _gaps(samples)
    _, curves = fits.context_curves(samples, gaps, gaps.where("run % 3 = 0").select(*K, "lo", "hi"), K)
    return curves.select(*K, "run", "method", "left", "right", r6(F.col("rms")).alias("rms"))


def c13_spline_fit(spark, sf_dir):
    """The bounded curve of each second that brings what is told of its frames near to what is seen of them."""
    samples, frames = _seconds(spark, sf_dir)
    at = W.framed(samples.where("index = 0").select(*K, "frame", F.col("q").alias("qa")), K, "frame", 0, 1, {"qb": lambda _, w: F.lead("qa").over(w)})
    seen = frames.where("ix is not null").select(*K, "frame", Q.from_rotation_vector(Q.vec(-F.col("ix"), -F.col("iy"), -F.col("iz"))).alias("target"))
    span = F.floor(F.col("frame") / 50)
    pairs = at.where("qb is not null").join(seen, [*K, "frame"]).withColumn("span", span).select(*K, "span", F.col("span").cast("double").alias("lo"), (F.col("span") + 1.0).alias("hi"), (F.col("frame") / FPS).alias("ta"), ((F.col("frame") + 1) / FPS).alias("tb"), "qa", "qb", "target", F.lit(0.3).alias("spread"))
    found = fits.spline_fit(pairs, [*K, "span"])
    return found.select(*K, "span", "knot", *(F.round(F.col(k), 4).alias(k) for k in ("x", "y", "z", "cost")), "n")


def c09_fullrate_trial(spark, sf_dir):
    """Samples in windows of two seconds, turned towards their motion below 8 Hz read two milliseconds later."""
    samples, _ = _seconds(spark, sf_dir)
    samples = stored(samples.select(*K, "t", "q"), "samples")  # read four times
    ends = samples.groupBy(*K).agg(F.max("t").alias("end")).where("end >= 4.5")
    at = ends.select(*K, "end", F.explode(F.sequence(F.lit(0), F.floor((F.col("end") - 4) / 10).cast("int"))).alias("k")).select(*K, (F.col("k") * 10.0 + 1).alias("lo"), (F.col("k") * 10.0 + 3).alias("hi"))
    both = at.union(at.select(*K, F.col("lo") + 1, F.col("hi") + 0.5))
    found = fits.fullrate_trial(samples, both, K, 200.0, 8.0, 0.5, shift=0.002)
    return found.select(*K, r6(F.col("t")).alias("t"), *flat(F.col("q"), "q"), *flat(F.col("applied"), "a", "xyz"))


def m12_session_rates(spark, sf_dir):
    """What is told of the motion between two frames, in the axes of what is seen."""
    samples, frames = _seconds(spark, sf_dir)
    last = F.broadcast(frames.groupBy(*K).agg(F.max("frame").alias("last")))
    pairs = frames.join(last, K).where("frame < last").select(*K, "frame", F.col("iz").alias("sx"), (-F.col("ix")).alias("sy"), F.col("iy").alias("sz"), F.col("points").alias("support"))
    found = fits.session_rates(samples, pairs.select(*K, "frame", *((F.col(s) * -FPS).alias(s) for s in ("sx", "sy", "sz")), "support"), K, FPS, 13.58)
    return found.select(*K, "frame", *(r6(F.col(k)).alias(k) for k in ("x", "y", "z", "err")))


def _rates(samples, frames):
    """(rates, maps): what is told and seen of the motion between two frames, and the order of axes, which is the same here."""
    at = W.framed(samples.where("index = 0").select(*K, "frame", "q"), K, "frame", 0, 1, {"next": lambda _, w: F.lead("q").over(w)}).where("next is not null").withColumn("v", Q.increment(F.col("next"), F.col("q")))
    told = at.select(*K, "frame", *((F.col(f"v.{a}") * FPS).alias(f"g{a}") for a in "xyz"))
    rates = frames.join(told, [*K, "frame"]).select(*K, "frame", ((F.col("frame") + 0.5) / FPS).alias("t"), "gx", "gy", "gz", *((F.col(f"i{a}") * -FPS).alias(f"s{a}") for a in "xyz"), (F.col("points") / 500).alias("confidence"))
    return rates, frames.select(*K).distinct().select(*K, F.array(*map(F.lit, (0, 1, 2))).alias("p"), F.array(*map(F.lit, (1, 1, 1))).alias("s"))


def c11_detail_targets(spark, sf_dir):
    """Attitudes in gaps with the detail that pictures show, ending where they did."""
    samples, frames = _seconds(spark, sf_dir)
    rates, maps = _rates(samples, frames)
    found, _ = fits.detail_targets(samples, _gaps(samples), rates, maps, K, 1 / FPS)
    return found.select(*K, "run", r6(F.col("t")).alias("t"), *flat(F.col("q"), "q"))


def _session(spark, sf_dir):
    """(samples, events, rates, maps): events of both sorts, some with another one that overlaps them. Kept, as a repair reads them many times."""
    samples, frames = _seconds(spark, sf_dir)
    rates, maps = _rates(samples, frames)
    gaps = _gaps(samples)
    late = gaps.where("run % 4 = 0").select(*K, (F.col("run") * 2 + 1).alias("run"), (F.col("lo") + 0.12).alias("lo"), (F.col("hi") + 0.1).alias("hi"))
    events = gaps.select(*K, (F.col("run") * 2).alias("run"), "lo", "hi").union(late)
    events = events.withColumn("kind", F.when(F.col("run") % 3 == 0, "gyro_fault").otherwise("large_impulse"))
    return kept(samples.drop("inverted")), kept(events), kept(rates), maps


def c12_session_repair(spark, sf_dir):
    """Every sample with its attitude after all events are repaired."""
    found, _ = session_repair.session_repair(*_session(spark, sf_dir), K, 1 / FPS)
    return found.select(*K, "frame", "index", *flat(F.col("q"), "q"), *flat(F.col("applied"), "a", "xyz"))


def c12_repairs(spark, sf_dir):
    """What each repair rests on, with all guards."""
    _, found = session_repair.session_repair(*_session(spark, sf_dir), K, 1 / FPS, settings=session_repair.Settings(guards=session_repair.GUARDS))
    return found.select(*K, "run", "kind", "method", "used", "frames", *(F.round(F.col(c), 5).alias(c) for c in ("lo", "hi", "rms", "drift", "predicted", "motion", "disagreement", "scale", "quality", "gain")))


def c12_timings(spark, sf_dir):
    """The repaired samples read at the four timings."""
    samples, *rest = _session(spark, sf_dir)
    found, _ = session_repair.session_repair(samples, *rest, K, 1 / FPS)
    shifts = samples.where("index = 0").select(*K, "frame", (F.col("frame") % 7 * 150.0 - 6790).alias("shift_us"))
    timed = session_repair.timed_variants(found, shifts, K, -13580.0)
    return timed.select(*K, "frame", "index", "variant", *flat(F.col("q"), "q"))


def c12_velocity(spark, sf_dir):
    """Degrees a second from frame to frame after the repair."""
    samples, events, rates, maps = _session(spark, sf_dir)
    found, _ = session_repair.session_repair(samples, events, rates, maps, K, 1 / FPS)
    return session_repair.frame_velocity(found, rates, maps, K, FPS).select(*K, "frame", *(r6(F.col(a)).alias(a) for a in "xyz"))


QUERIES = {f.__name__: f for f in (m07_lens_lift, m03_rotation_fit, m02_affine_flow, c10_context_curve, c10_curves, c13_spline_fit, c09_fullrate_trial, m12_session_rates, c11_detail_targets, c12_session_repair, c12_repairs, c12_timings, c12_velocity)}
ORACLE = {"m07_lens_lift": M07}
