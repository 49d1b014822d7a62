"""Whole builds over a motion that is told by samples and seen by frames; SQL can't tell their filters, the tests hold them against plain numpy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import quaternion as Q
from ..operators import builds
from .series import K
from .views import flat, r6, sig

FPS, PER_FRAME = 50.0, 4


def _attitude(seconds: Column, phase: Column, offset: Column | None = None) -> Column:
    """A smooth motion; offset: what is told beyond it, about the second axis."""
    turn = lambda hz, k: F.sin(2 * F.pi() * hz * seconds + phase * k)
    pitch = 40 * turn(0.11, 2) + 2 * turn(0.7, 1)
    return Q.from_euler(50 * turn(0.07, 1) + 3 * turn(0.5, 3), pitch if offset is None else pitch + offset, 30 * turn(0.13, 3))


def telemetry(spark, sf_dir):
    """(samples, frames) of the series of events: a frame for each event, four samples a frame.

    What is told turns away from the motion by half a degree a frame for 15 frames of every 1000, jumps at two frames of every 1000, and trembles
    with the event's value; what is seen misses every 29th event.
    """
    e = sig(spark, sf_dir).withColumn("phase", F.length("clip_id") * 0.7)
    place = F.col("frame") % 1000
    ramp = F.least(F.greatest(place - 700, F.lit(0)), F.lit(15)) * 0.5
    jump = F.when(place.between(300, 309), 1.8).otherwise(0.0)
    e = e.withColumn("offset", ramp + jump + F.col("x") * 0.004).withColumn("t0", F.col("frame") * 1e6 / FPS)
    samples = e.select("*", F.explode(F.sequence(F.lit(0), F.lit(PER_FRAME - 1))).alias("index")).withColumn("t", F.col("t0") + F.col("index") * (1e6 / FPS / PER_FRAME))
    samples = samples.select("clip_id", "t", "frame", "index", _attitude(F.col("t") / 1e6, F.col("phase"), F.col("offset")).alias("q"), ((F.col("event_id") + F.col("index")) % 7 == 0).alias("inverted"))
    at = lambda k: _attitude((F.col("frame") + k) / FPS, F.col("phase"))
    step = lambda k: Q.let(F.struct(at(0).alias("a"), at(k).alias("b")), lambda m: Q.increment(m["a"], m["b"]))
    f = e.select("clip_id", "frame", "event_id", (8 + F.col("event_id") % 5).cast("double").alias("exposure"), step(1).alias("i"), step(5).alias("g"))
    # the last frame of each series is sent to all tasks, so that no task gets a whole series
    last = F.broadcast(e.groupBy(F.col("clip_id").alias("_c")).agg(F.max("frame").alias("end")))
    f = f.join(last, F.expr("clip_id <=> _c")).drop("_c")
    off = lambda k: (F.col("event_id") * k % 101) / 101.0 * 0.01 - 0.005
    seen = F.col("event_id") % 29 != 0
    window = F.col("frame") <= F.col("end") - 5
    cols = {f"i{a}": F.when(seen, F.col(f"i.{a}") + off(7 + k)) for k, a in enumerate("xyz")}
    cols |= {"curl": F.col("i.z") + off(31), "points": F.when(F.col("event_id") % 53 == 0, 100).otherwise(500), "sx": F.col("i.x") * 0.8 + off(41), "sy": F.col("i.y") * 0.8 + off(43)}
    cols |= {f"{n}{a}": F.when(window, s * F.col(f"g.{a}") + off(k)) for n, k in (("h", 51), ("k", 61)) for a, s in zip("xyz", (-1, 1, 1))}
    return samples, f.select("clip_id", "frame", "exposure", *(c.alias(n) for n, c in cols.items()), F.lit(300).alias("wpoints"))


def c01_main_build(spark, sf_dir):
    """Every sample with its corrected attitude, in the camera's frame and as it is stored."""
    samples, _, _ = builds.main_build(*telemetry(spark, sf_dir), K, builds.Settings(fps=FPS))
    return samples.select("clip_id", "frame", "index", *flat(F.col("q"), "q"), *flat(F.col("stored"), "s"))


def c01_build_frames(spark, sf_dir):
    """The parts of each frame's correction."""
    _, frames, _ = builds.main_build(*telemetry(spark, sf_dir), K, builds.Settings(fps=FPS))
    return frames.select("clip_id", "frame", "spike", *(r6(F.col(c)).alias(c) for c in ("roll", "px", "py", "ex", "ey", "jx", "jy", "theta_x", "theta_y", "theta_z")))


def w24_lowpass_events(spark, sf_dir):
    """The events of a build whose told motion is smoothed below 8 Hz, each window with two seconds on both sides."""
    _, _, events = builds.main_build(*telemetry(spark, sf_dir), K, builds.Settings(fps=FPS, event_model="lowpass"))
    return events.select("clip_id", "run", "a", "b", "spike", r6(F.col("peak")).alias("peak"), r6(F.col("weight")).alias("weight"), "verdict")


def a03_measured_shift(spark, sf_dir):
    """The shift in milliseconds at which what is told of the roll is nearest to what is seen, and whether it is clear (A4)."""
    found = builds.measured_shift(*telemetry(spark, sf_dir), K, builds.Settings(fps=FPS))
    return found.select("clip_id", *(r6(F.col(c)).alias(c) for c in ("shift", "best", "zero")), "clear", "used")


EXPOSURE = builds.Settings(fps=FPS, timing="exposure")


def _samples(samples):
    return samples.select("clip_id", "frame", "index", *flat(F.col("q"), "q"), *flat(F.col("stored"), "s"))


def c02_noise_build(spark, sf_dir):
    """Samples without the noise of all three axes, by fixed shares."""
    return _samples(builds.noise_build(*telemetry(spark, sf_dir), K, EXPOSURE)[0])


def c04_roll_build(spark, sf_dir):
    """Samples whose roll follows what is seen from 4 Hz on."""
    return _samples(builds.roll_build(*telemetry(spark, sf_dir), K, EXPOSURE)[0])


def c04_burst_build(spark, sf_dir):
    """Samples whose roll follows what is seen in bursts."""
    return _samples(builds.burst_build(*telemetry(spark, sf_dir), K, EXPOSURE, least=0.02)[0])


def c06_align_build(spark, sf_dir):
    """Samples at the instant that each frame's exposure stands for, a millisecond later."""
    samples, frames = telemetry(spark, sf_dir)
    return _samples(builds.align_build(samples, frames.withColumn("shift", (F.col("exposure") - 10) * 400), K, "shift", EXPOSURE, extra_ms=1.0))


def c07_control(spark, sf_dir):
    """Samples with their timing alone put right."""
    return _samples(builds.control(*telemetry(spark, sf_dir), K, builds.Settings(fps=FPS)))


QUERIES = {f.__name__: f for f in (c01_main_build, c01_build_frames, w24_lowpass_events, a03_measured_shift, c02_noise_build, c04_roll_build, c04_burst_build, c06_align_build, c07_control)}
ORACLE: dict[str, str] = {}
