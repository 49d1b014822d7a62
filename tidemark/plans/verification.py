"""Queries that hold readings against each other, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quaternion as Q
from ..operators import verification
from .builds import FPS, telemetry
from .series import K
from .views import DUO, QUAT, duo, flat, quat, r6, s6


def k13_attitudes(spark, sf_dir):
    """Attitudes of two readers matched by whole microseconds, give or take one."""
    q = quat(spark, sf_dir)
    moved = Q.let(F.col("q"), lambda v: Q.quat(v["w"], v["x"] + 1e-4 * (F.col("vec_id") % 5), v["y"], v["z"] - 2e-4 * (F.col("vec_id") % 3)))
    theirs = q.where("vec_id % 9 <> 0").select("clip_id", (F.col("t").cast("long") + F.col("vec_id") % 4 - 1).alias("key"), moved.alias("q"))
    found = verification.parse_check(q.select("clip_id", "t", "q"), theirs, K)
    return found.select("clip_id", "n", "matched", r6(F.col("worst")).alias("worst"))


def w23_second_paths(spark, sf_dir):
    """What is left of two paths within each second, without its quadratic."""
    found = verification.second_paths(duo(spark, sf_dir), K, "frame", ["x", "ix"], FPS)
    return found.select("clip_id", "frame", "second", *(F.round(F.col(c), 5).alias(c) for c in ("x", "ix")))


def r03_series_at_frames(spark, sf_dir):
    """Attitudes and motions at every frame of each recording, read 3.4 ms later."""
    samples, frames = telemetry(spark, sf_dir)
    counts = frames.groupBy(*K).agg((F.max("frame") + 1).alias("n"))
    found = verification.series_at_frames(samples, counts, K, FPS, 3.4)
    return found.select(*K, "frame", *flat(F.col("q"), "q"), *flat(F.col("v"), "v", "xyz"))


QUERIES = {f.__name__: f for f in (k13_attitudes, w23_second_paths, r03_series_at_frames)}

_sums = lambda v: ", ".join(f"sum(y{v} * u ** {k}) OVER w AS {v}{k}" for k in (0, 1, 2))
_left = lambda v: f"round(CASE WHEN n > 3 THEN y{v} - ({v}0 * s4 - {v}2 * s2) / (n * s4 - s2 * s2) - {v}1 / s2 * u - (n * {v}2 - s2 * {v}0) / (n * s4 - s2 * s2) * u * u ELSE 0 END, 5) AS {v}"

ORACLE = {
    "k13_attitudes": f"""WITH {QUAT}, o AS (SELECT clip_id, t::BIGINT + vec_id % 4 - 1 AS key, w, x + 1e-4::DOUBLE * (vec_id % 5) AS x, y, z - 2e-4::DOUBLE * (vec_id % 3) AS z FROM quat WHERE vec_id % 9 <> 0),
        m AS (SELECT q.clip_id, q.t, arg_min(greatest(abs(q.w - o.w), abs(q.x - o.x), abs(q.y - o.y), abs(q.z - o.z)), turn) FILTER (o.key IS NOT NULL) AS off FROM quat q CROSS JOIN (VALUES (0, 0), (1, 1), (2, -1)) d(turn, step) LEFT JOIN o ON o.clip_id = q.clip_id AND o.key = q.t::BIGINT + step GROUP BY ALL)
        SELECT clip_id, count(*) AS n, count(off) AS matched, {s6('max(off)')} AS worst FROM m GROUP BY clip_id""",
    "w23_second_paths": f"""WITH {DUO}, y AS (SELECT clip_id, frame, frame // {round(FPS)} AS second, sum(x) OVER r AS yx, sum(coalesce(ix, 0)) OVER r AS yix, row_number() OVER r - (count(*) OVER (PARTITION BY clip_id, frame // {round(FPS)}) + 1) / 2 AS u FROM duo WINDOW r AS (PARTITION BY clip_id, frame // {round(FPS)} ORDER BY frame)),
        s AS (SELECT *, count(*) OVER w AS n, sum(u ** 2) OVER w AS s2, sum(u ** 4) OVER w AS s4, {_sums('x')}, {_sums('ix')} FROM y WINDOW w AS (PARTITION BY clip_id, second)) SELECT clip_id, frame, second::BIGINT AS second, {_left('x')}, {_left('ix')} FROM s""",
}
