"""Queries over sessions: three readings of one motion, impulses found in them, and measures of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corrections as C
from ..operators import filters
from ..operators import islands as I
from ..operators import sessions as S
from .composites import _detail_sql
from .series import K, _runs
from .views import SIG, r6, s6, sig

DT = 0.02

# What each reading is made of: a multiplier of the event's number for its noise, and how large that is.
_NOISE = {"gx": (7919, 3.0), "gy": (104729, 3.0), "gz": (31, 3.0), "tx": (17, 0.3), "ty": (19, 0.3), "tz": (23, 0.3)}


def _noise(k: int) -> str:
    return f"((event_id * {k} % 1009) / CAST(504.5 AS DOUBLE) - 1)"


def _readings() -> dict[str, str]:
    """The readings in SQL that both engines know: a gyro that goes wrong for three frames in 331, a source picture that sees the
    motion and misses every 29th event, and a stabilised picture with large impulses, jitter, and jumps against the gyro's."""
    wrong = "frame % 331 IN (0, 1, 2)"
    told = {n: f"{s} * {_noise(k)}" for n, (k, s) in _NOISE.items()}
    told |= {f"s{a}": f"CASE WHEN event_id % 29 <> 0 THEN {told[f'g{a}']} + 0.1 * {_noise(53)} END" for a in "xyz"}
    told["gx"] += f" + CASE WHEN {wrong} THEN 12 ELSE 0 END"
    told["tx"] += f" + CASE WHEN {wrong} THEN -10 WHEN frame % 211 = 50 THEN 9 ELSE 0 END"
    told["ty"] += " + CASE WHEN frame % 503 BETWEEN 100 AND 105 THEN 3 - 6 * (frame % 2) ELSE 0 END"
    return told | {"conf_s": "CASE WHEN event_id % 41 = 0 THEN 0.1 ELSE 0.9 END", "conf_t": "0.95"}


_VALUES = [k + a for k in "gst" for a in "xyz"]


def _session(spark, sf_dir) -> DataFrame:
    return sig(spark, sf_dir).select("clip_id", "frame", *(F.expr(e).cast("double").alias(n) for n, e in _readings().items()))


def i10_session_events(spark, sf_dir):
    found = S.outliers(_session(spark, sf_dir), K, "frame", DT)
    exact = {"clip_id", "id", "peak_frame", "peak_axis", "strength", "level", "kind"}
    return found.select(*(c if c in exact else r6(F.col(c)).alias(c) for c in found.columns))


def _measured(spark, sf_dir) -> DataFrame:
    """The stabilised picture's measures in every interval in which it is calm for long."""
    d = _session(spark, sf_dir)
    t = ["tx", "ty", "tz"]
    detail = C.details(d.select("clip_id", "frame", *t), K, "frame", t, 7).toDF("clip_id", "frame", "dx", "dy", "dz")
    high = filters.butterworth("high", 5.0, 1 / DT)
    fast = filters.filtered_all(d, K, "frame", t, lambda x: filters.zero_phase(x, high)).toDF("clip_id", "frame", "hx", "hy", "hz")
    rows = d.select("clip_id", "frame", *t).join(detail, ["clip_id", "frame"]).join(fast, ["clip_id", "frame"])
    spans = I.islands(d.where("frame % 97 >= 40"), K, "frame", 0).select("clip_id", F.col("run").alias("case"), "first", "last").where("last > first")
    return S.interval_measures(rows, spans, K, "frame", "case", t, ["dx", "dy", "dz"], ["hx", "hy", "hz"], DT)


def a15_metric_set(spark, sf_dir):
    found = _measured(spark, sf_dir).drop("high_rms")
    return found.select("clip_id", "case", *(r6(F.col(c)).alias(c) for c in found.columns[2:]))


def a15_high_frequency(spark, sf_dir):
    return _measured(spark, sf_dir).select("clip_id", "case", r6(F.col("high_rms")).alias("high_rms"))


_SS = f"WITH {SIG}, ss AS (SELECT clip_id, frame, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in _readings().items())} FROM sig)"
_MANY = lambda names: ", ".join(_detail_sql(f"d{n}", "ss", n, 3) for n in names)
_MET = lambda names: " ".join(f"JOIN d{n} USING (clip_id, frame)" for n in names)
_ROWS = "over (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN {0} PRECEDING AND {0} FOLLOWING)".format
_NORM = lambda *c: f"sqrt({' + '.join(f'({x}) ** 2' for x in c)})"
_STRENGTH = "greatest(10, least(100, 10 + 90 * (1 - exp(-0.65::DOUBLE * (sqrt(greatest(p.s / 8, 1) * greatest(p.i / 5, 1)) - 1)))))"
_TOLD = "{'fr': frame, 'x': ax, 'y': ay, 'w': aw, 's': score, 'i': imp, 'z': z, 'ab': ab, 'fa': fault, 'an': agn, 'c': calm}"

ORACLE = {
    "i10_session_events": f"""{_SS}, {_MANY(_VALUES)},
        v AS (SELECT s.clip_id, s.frame, {_NORM('gx - sx', 'gy - sy', 'gz - sz')} AS ab, {' AND '.join(f's.{c} IS NOT NULL' for c in _VALUES)} AND conf_s >= 0.2 AND conf_t >= 0.2 AS valid, {', '.join(f'd{c}.v AS d{c}' for c in _VALUES)}, {', '.join(f'dg{a}.v - ds{a}.v AS e{a}' for a in 'xyz')} FROM ss s {_MET(_VALUES)}),
        v1 AS (SELECT clip_id, {', '.join(f'greatest(0.35, 1.4826::DOUBLE * mad(e{a}) FILTER (valid)) AS k{a}' for a in 'xyz')} FROM v GROUP BY clip_id), v2 AS (SELECT v.*, sqrt({_NORM('ex / kx', 'ey / ky', 'ez / kz')} ** 2 / 3) AS z FROM v JOIN v1 USING (clip_id)),
        v3 AS (SELECT *, coalesce(valid AND z <= 4 AND ab <= 15, false) AS trusted FROM v2), v4 AS (SELECT clip_id, {', '.join(f'greatest(0.2, 1.4826::DOUBLE * mad(dt{a}) FILTER (trusted)) AS q{a}' for a in 'xyz')} FROM v3 GROUP BY clip_id),
        v5 AS (SELECT v3.*, abs(dtx) / qx AS ax, abs(dty) / qy AS ay, abs(dtz) / qz AS aw, {_NORM('dtx', 'dty', 'dtz')} AS imp, {_NORM('ex', 'ey', 'ez')} AS fault, {_NORM('dsx', 'dsy', 'dsz')} AS calm FROM v3 JOIN v4 USING (clip_id)),
        v6 AS (SELECT *, greatest(ax, ay, aw) AS score, CASE WHEN fault * imp > 1e-9 THEN -(ex * dtx + ey * dty + ez * dtz) / (fault * imp) ELSE 0 END AS agn FROM v5),
        v7 AS (SELECT *, trusted AND score >= 8 AND imp >= 5 AS large, trusted AND score >= 4 AND imp >= 2 AS mc, coalesce(valid AND fault >= 8 AND imp >= 5 AND agn >= 0.7 AND calm <= 8, false) AS fc FROM v6),
        v8 AS (SELECT *, mc AND sum(mc::INTEGER) {_ROWS(2)} >= 2 AND NOT bool_or(large) {_ROWS(12)} AS micro, fc AND sum(fc::INTEGER) {_ROWS(2)} >= 2 AS seed FROM v7),
        v9 AS (SELECT *, bool_or(seed) {_ROWS(12)} AND coalesce(valid AND score >= 20 AND imp >= 5, false) AS bad FROM v8), c AS (SELECT *, large OR micro OR bad AS core FROM v9), f AS (SELECT * FROM (SELECT *, bool_or(core) {_ROWS(3)} AS near FROM c) WHERE near AND valid),
        {_runs('f', 6, f", arg_max({_TOLD}, {{'s': round(score, 9), 'f': -frame}}) FILTER (core) AS p, bool_or(bad) AS bad, bool_or(large) AS large")}
        SELECT clip_id, run + 1 AS id, {s6('greatest(0, first * 0.02::DOUBLE - 0.01::DOUBLE)')} AS start_s, {s6('last * 0.02::DOUBLE + 0.01::DOUBLE')} AS end_s, {s6('(last - first + 1) * 0.02::DOUBLE')} AS duration_s, p.fr AS peak_frame, CASE WHEN p.x >= p.y AND p.x >= p.w THEN 'X' WHEN p.y >= p.w THEN 'Y' ELSE 'Z/roll' END AS peak_axis,
        {', '.join(f'{s6(f"p.{k}")} AS {n}' for k, n in (('s', 'peak_score'), ('i', 'peak_impulse'), ('z', 'agreement'), ('ab', 'difference'), ('fa', 'gyro_fault'), ('an', 'against'), ('c', 'source_detail')))}, round({_STRENGTH}, 1) AS strength,
        CASE WHEN {_STRENGTH} < 35 THEN 'weak' WHEN {_STRENGTH} < 65 THEN 'medium' WHEN {_STRENGTH} < 85 THEN 'strong' ELSE 'extreme' END AS level, CASE WHEN bad THEN 'gyro_fault' WHEN large THEN 'large_impulse' ELSE 'micro_jitter' END AS kind FROM r""",
    "a15_metric_set": f"""{_SS}, {_MANY(_VALUES[6:])}, f AS (SELECT * FROM ss WHERE frame % 97 >= 40), {_runs('f', 0)},
        m AS (SELECT r.clip_id, run AS "case", s.frame, tx, ty, tz, dtx.v AS dx, dty.v AS dy, dtz.v AS dz FROM ss s {_MET(_VALUES[6:])} JOIN r ON r.clip_id = s.clip_id AND s.frame BETWEEN first AND last WHERE last > first),
        e AS (SELECT *, {', '.join(f't{a} - avg(t{a}) OVER (PARTITION BY clip_id, "case") AS c{a}, (t{a} - lag(t{a}) OVER (PARTITION BY clip_id, "case" ORDER BY frame)) / 0.02::DOUBLE AS j{a}' for a in 'xyz')} FROM m),
        x AS (SELECT *, {', '.join(f'sum(c{a}) OVER (PARTITION BY clip_id, "case" ORDER BY frame) * 0.02::DOUBLE AS u{a}' for a in 'xyz')} FROM e),
        l AS (SELECT clip_id, "case", {_NORM('ux', 'uy', 'uz')} AS stray, {_NORM('tx', 'ty', 'tz')} AS speed, {_NORM('dx', 'dy', 'dz')} AS impulse, {_NORM('jx', 'jy', 'jz')} AS jerk FROM x)
        SELECT clip_id, "case", {s6('max(stray)')} AS excursion_peak, {', '.join(f'{s6(f"max({n})")} AS {n}_peak, {s6(f"sqrt(avg({n} * {n}))")} AS {n}_rms' for n in ('speed', 'impulse', 'jerk'))} FROM l GROUP BY ALL""",
}

QUERIES = {name: globals()[name] for name in (*ORACLE, "a15_high_frequency")}
