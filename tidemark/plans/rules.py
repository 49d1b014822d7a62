"""Queries over rules with all their conditions: spikes by the camera's own rate, axes that must correlate, scores of five measures, calm stretches."""

from __future__ import annotations


from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..operators import spikes, stats
from ..operators import windows as W
from .series import _MED, K
from .views import DUO, duo, r6, s6

CONSTANT_AXIS = (0.2, 0.3, 0.9)


def i06_spikes_corrected(spark, sf_dir):
    """Jumps that either of two witnesses goes against, where the rate's median of five is low, with what puts them right."""
    d = duo(spark, sf_dir).withColumn("valid", F.col("event_id") % 41 != 0)
    d = W.medians(d, K, "frame", 5, {"camera": "rate"}).select("*", *((F.col(f"i{a}") - F.col(a)).alias(f"s{a}") for a in "xy"))
    d = spikes.unconfirmed(d, K, "frame", ["x", "y"], ["ix", "iy"], "rate", second=["sx", "sy"], camera="camera", camera_max=200.0, valid="valid")
    return d.where("spike or contaminated").select("clip_id", "frame", r6(F.col("jump")).alias("jump"), "spike", "contaminated", r6(F.col("c_x")).alias("cx"), r6(F.col("c_y")).alias("cy"))


_PAD = ", ".join(f"arg_{{0}}({c}, frame)" for c in ("vx", "vy", "rate"))
I06 = f"""WITH {DUO}, v AS (SELECT *, event_id % 41 <> 0 AS valid, CASE WHEN event_id % 41 <> 0 THEN x ELSE 0 END AS vx, CASE WHEN event_id % 41 <> 0 THEN y ELSE 0 END AS vy FROM duo),
    pad AS (SELECT clip_id, frame, vx, vy, rate, true AS own FROM v UNION ALL SELECT clip_id, min(frame) - k, {_PAD.format('min')}, false FROM v, range(1, 3) t(k) GROUP BY clip_id, k UNION ALL SELECT clip_id, max(frame) + k, {_PAD.format('max')}, false FROM v, range(1, 3) t(k) GROUP BY clip_id, k),
    m AS (SELECT clip_id, frame, {_MED('vx', 2, 2)} AS mx, {_MED('vy', 2, 2)} AS my, {_MED('rate', 2, 2)} AS camera, own FROM pad),
    r AS (SELECT v.*, camera, x - mx AS rx, y - my AS ry, sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) AS jump FROM v JOIN m USING (clip_id, frame) WHERE own),
    s AS (SELECT *, valid AND jump >= 0.35 AND rate < 150 AND camera < 200 AND (coalesce(ix, 0) * rx + coalesce(iy, 0) * ry < -0.5 * jump * jump OR coalesce(ix - x, 0) * rx + coalesce(iy - y, 0) * ry < -0.5 * jump * jump) AS spike FROM r),
    n AS (SELECT *, sum(spike::INTEGER) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) > 0 AND NOT spike AS contaminated FROM s)
    SELECT clip_id, frame, {s6('jump')} AS jump, spike, contaminated, {s6('CASE WHEN spike THEN -rx ELSE 0 END')} AS cx, {s6('CASE WHEN spike THEN -ry ELSE 0 END')} AS cy FROM n WHERE spike OR contaminated"""


def _fits(spark, sf_dir):
    """The series, some of which see something else."""
    d = duo(spark, sf_dir)
    other = (F.col("event_id") * 613 % 997) / F.lit(500.0)
    return d.withColumn("seen", F.when(F.length("clip_id") % 2 == 0, F.col("ix")).otherwise(other))


def a02_axis_rules(spark, sf_dir):
    """The axis along which the steps tell what is seen, where the two go together: else a constant one (0.9), or none (0.8)."""
    d, use = _fits(spark, sf_dir), (F.col("rate") > 20) & (F.col("rate") < 150)
    a = stats.axis_fit(d, K, ("x", "y", "z"), "seen", use, 0.9, otherwise=CONSTANT_AXIS)
    b = stats.axis_fit(d, K, ("x", "y", "z"), "seen", use, 0.8).select("clip_id", F.col("ax").isNull().alias("none"))
    return a.join(b, "clip_id").select("clip_id", *(r6(F.col(c)).alias(c) for c in ("ax", "ay", "az", "gain", "corr")), "n", "none")


def _det(a: str, b: str, c: str) -> str:
    m = [[f"{p}x", f"{p}y", f"{p}z"] for p in (a, b, c)]
    return f"({m[0][0]}*({m[1][1]}*{m[2][2]}-{m[1][2]}*{m[2][1]}) - {m[0][1]}*({m[1][0]}*{m[2][2]}-{m[1][2]}*{m[2][0]}) + {m[0][2]}*({m[1][0]}*{m[2][1]}-{m[1][1]}*{m[2][0]}))"


_SUMS = ", ".join(f"sum({a}*{b}) AS {a}{b}" for a in "xyz" for b in "xyz") + ", " + ", ".join(f"sum({a}*seen) AS t{a}" for a in "xyz")
A02 = f"""WITH {DUO}, d AS (SELECT *, CASE WHEN length(clip_id) % 2 = 0 THEN ix ELSE (event_id * 613 % 997) / 500.0::DOUBLE END AS seen FROM duo), u AS (SELECT * FROM d WHERE rate > 20 AND rate < 150 AND seen IS NOT NULL),
    s AS (SELECT clip_id, count(*) AS n, {_SUMS} FROM u GROUP BY clip_id), f AS (SELECT clip_id, n, {_det('t', 'y', 'z')} / {_det('x', 'y', 'z')} AS a, {_det('x', 't', 'z')} / {_det('x', 'y', 'z')} AS b, {_det('x', 'y', 't')} / {_det('x', 'y', 'z')} AS c FROM s),
    c AS (SELECT clip_id, corr(a*x + b*y + c*z, seen) AS corr, any_value(n) AS n, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c FROM u JOIN f USING (clip_id) GROUP BY clip_id),
    g AS (SELECT *, sqrt(a*a + b*b + c*c) AS g, n >= 200 AND corr >= 0.9 AS good FROM c)
    SELECT clip_id, {', '.join(f'{s6(f"CASE WHEN good THEN {p} / g ELSE {v / sum(x * x for x in CONSTANT_AXIS) ** 0.5!r}::DOUBLE END")} AS a{k}' for p, k, v in zip('abc', 'xyz', CONSTANT_AXIS))},
      {s6(f"CASE WHEN good THEN g ELSE {sum(x * x for x in CONSTANT_AXIS) ** 0.5!r}::DOUBLE END")} AS gain, {s6('CASE WHEN n >= 200 THEN corr END')} AS corr, n, NOT (n >= 200 AND corr >= 0.8) AS "none" FROM g"""

MEASURES = ("peak", "rms", "jerk", "mean", "range")


def _measures(v: Column, step: Column) -> dict[str, Column]:
    return {"peak": F.max(F.abs(v)), "rms": F.sqrt(F.avg(v * v)), "jerk": F.sqrt(F.avg(step * step)), "mean": F.avg(F.abs(v)), "range": F.max(v) - F.min(v)}


def a16_five_measures(spark, sf_dir):
    """The mean improvement of a second's five measures, those without a value before left out, and what that makes of it."""
    w = Window.partitionBy("clip_id").orderBy("frame")
    d = duo(spark, sf_dir).select("clip_id", "frame", F.floor(F.col("frame") / 50).cast("int").alias("second"), F.col("x").alias("u"), (F.col("x") - F.when(F.col("event_id") % 3 != 0, F.coalesce("ix", F.lit(0.0))).otherwise(F.col("x") * -0.1)).alias("v"))
    d = d.select("*", (F.col("u") - F.lag("u").over(w)).alias("du"), (F.col("v") - F.lag("v").over(w)).alias("dv"))
    g = d.groupBy("clip_id", "second").agg(*(c.alias(f"b_{n}") for n, c in _measures(F.col("u"), F.col("du")).items()), *(c.alias(f"a_{n}") for n, c in _measures(F.col("v"), F.col("dv")).items()))
    gains = F.array_compact(F.array(*(F.when(F.col(f"b_{n}") > 1e-9, 100 * (F.col(f"b_{n}") - F.col(f"a_{n}")) / F.col(f"b_{n}")) for n in MEASURES)))
    score = F.when(F.size(gains) > 0, F.round(F.aggregate(gains, F.lit(0.0), lambda s, x: s + x) / F.size(gains), 6))
    return g.select("clip_id", "second", score.alias("score")).withColumn("verdict", F.when(F.col("score") >= 15, "improved").when(F.col("score") < -10, "worsened").otherwise("mixed_or_unchanged"))


_EACH = {"peak": "max(abs({0}))", "rms": "sqrt(avg({0} * {0}))", "jerk": "sqrt(avg(d{0} * d{0}))", "mean": "avg(abs({0}))", "range": "max({0}) - min({0})"}
A16 = f"""WITH {DUO}, d AS (SELECT clip_id, frame, (frame // 50)::INTEGER AS second, x AS u, x - CASE WHEN event_id % 3 <> 0 THEN coalesce(ix, 0) ELSE x * -0.1 END AS v FROM duo),
    e AS (SELECT *, u - lag(u) OVER w AS du, v - lag(v) OVER w AS dv FROM d WINDOW w AS (PARTITION BY clip_id ORDER BY frame)),
    g AS (SELECT clip_id, second, {', '.join(f'{f.format("u")} AS b_{n}, {f.format("v")} AS a_{n}' for n, f in _EACH.items())} FROM e GROUP BY clip_id, second),
    s AS (SELECT clip_id, second, round(list_avg(list_filter([{', '.join(f'CASE WHEN b_{n} > 1e-9 THEN 100 * (b_{n} - a_{n}) / b_{n} END' for n in _EACH)}], lambda x: x IS NOT NULL)), 6) AS score FROM g)
    SELECT *, CASE WHEN score >= 15 THEN 'improved' WHEN score < -10 THEN 'worsened' ELSE 'mixed_or_unchanged' END AS verdict FROM s"""


def i21_calm_zoom(spark, sf_dir):
    """Where three seconds with a picture in at least nine of ten frames have the least mean rate, tried every half second; the start if there are none."""
    mean = {"m": lambda rows, _: F.avg("rate").over(rows), "share": lambda rows, _: F.avg(F.when(F.col("ix").isNotNull(), 1.0).otherwise(0.0)).over(rows)}
    d = W.framed(duo(spark, sf_dir).select("clip_id", "frame", "rate", "ix"), K, "frame", 0, 149, mean)
    last = d.groupBy("clip_id").agg(F.max("frame").alias("end"))
    ok = d.join(last, "clip_id").where("frame % 25 = 0 and frame + 150 <= end and share >= 0.9").groupBy("clip_id").agg(F.min(F.struct(F.round("m", 6).alias("m"), "frame")).alias("b"))
    return last.join(ok, "clip_id", "left").select("clip_id", F.coalesce("b.frame", F.lit(0)).alias("frame"), r6(F.col("b.m")).alias("mean"))


I21 = f"""WITH {DUO}, m AS (SELECT clip_id, frame, avg(rate) OVER v AS m, avg(CASE WHEN ix IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) OVER v AS share, max(frame) OVER (PARTITION BY clip_id) AS last FROM duo WINDOW v AS (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 149 FOLLOWING)),
    b AS (SELECT clip_id, min({{'m': round(m, 6), 'f': frame}}) AS b FROM m WHERE frame % 25 = 0 AND frame + 150 <= last AND share >= 0.9 GROUP BY clip_id)
    SELECT clip_id, coalesce(b.f, 0) AS frame, {s6('b.m')} AS mean FROM (SELECT DISTINCT clip_id FROM duo) LEFT JOIN b USING (clip_id)"""

QUERIES = {f.__name__: f for f in (i06_spikes_corrected, a02_axis_rules, a16_five_measures, i21_calm_zoom)}
ORACLE = {"i06_spikes_corrected": I06, "a02_axis_rules": A02, "a16_five_measures": A16, "i21_calm_zoom": I21}
