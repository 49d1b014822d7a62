"""Queries over exports of a render's path."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quaternion as Q
from ..operators import exports
from .builds import FPS, telemetry
from .rotations import _step_sql
from .series import K
from .views import QUAT, quat, r6, s6


def k15_export_rates(spark, sf_dir):
    """The rates of a path from frame to frame; none at its end."""
    found = exports.flattened(quat(spark, sf_dir).select("clip_id", "vec_id", "q"), K, "vec_id", ["q"], FPS)
    return found.select("clip_id", "vec_id", *(r6(F.col(f"q_rate_{k}")).alias(f"rate_{k}") for k in "xyz"))


def _paths(spark, sf_dir):
    samples, _ = telemetry(spark, sf_dir)
    told = samples.where("index = 0").select(*K, "frame", F.col("q").alias("org"), Q.slerp(F.col("q"), Q.quat(1.0, 0.0, 0.0, 0.0), F.lit(0.6)).alias("stab"))
    rows = exports.flattened(told, K, "frame", ["org", "stab"], FPS)
    spans = rows.groupBy(*K).agg(F.max("frame").alias("end")).select(*K, F.explode(F.sequence(F.lit(0), F.floor(F.col("end") / 100).cast("int"))).alias("run"))
    return rows, spans.select(*K, "run", (F.col("run") * 100).alias("a"), (F.col("run") * 100 + 99).alias("b"))


def k15_export_measures(spark, sf_dir):
    """How fast both paths turn in every two seconds, in all and above 4 Hz, and where most."""
    found = exports.measures(*_paths(spark, sf_dir), K, "frame", ["org", "stab"], FPS)
    return found.select(*K, "run", "path", *(r6(F.col(c)).alias(c) for c in ("rms", "fast_rms", "fast_peak")), "peak_frame")


def k15_turning_points(spark, sf_dir):
    """Where yaw is highest and roll lowest in every two seconds, of both paths, and how far they come back."""
    found = exports.turning_points(*_paths(spark, sf_dir), K, "frame", {"org_yaw": 1, "org_roll": -1, "stab_yaw": 1, "stab_roll": -1})
    return found.select(*K, "run", "angle", "frame", r6(F.col("value")).alias("value"), r6(F.col("back")).alias("back"))


QUERIES = {f.__name__: f for f in (k15_export_rates, k15_export_measures, k15_turning_points)}
ORACLE = {
    "k15_export_rates": f"""WITH {QUAT}, s AS (SELECT clip_id, vec_id, struct_pack(w := w, x := x, y := y, z := z) AS q FROM quat), src AS (SELECT clip_id, vec_id, q, lead(q) OVER (PARTITION BY clip_id ORDER BY vec_id) AS r FROM s),
    {_step_sql('q', 'r', 'src', 'clip_id, vec_id')} SELECT clip_id, vec_id, {', '.join(f'{s6(f"e.{k} * 50")} AS rate_{k}' for k in 'xyz')} FROM p2""",
}
