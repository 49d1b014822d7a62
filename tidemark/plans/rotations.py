"""Queries over single rotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import quaternion as Q
from ..operators import asof
from ..operators import windows as W
from .views import QUAT, flat, q_mul, quat, r6, s6, sflat

_NEXT = f"""WITH {QUAT}, s AS (SELECT clip_id, vec_id, t, struct_pack(w := w, x := x, y := y, z := z) AS q FROM quat),
    p AS (SELECT *, coalesce(lead(q) OVER (PARTITION BY clip_id ORDER BY vec_id), q) AS r FROM s)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quat(spark, sf_dir)
    return q.withColumn("r", F.coalesce(F.lead("q").over(Window.partitionBy("clip_id").orderBy("vec_id")), F.col("q")))


def q01_product(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", *flat(Q.product(F.col("q"), F.col("r")), "p"))


def q02_conj_dot_norm(spark, sf_dir):
    q, r = F.col("q"), F.col("r")
    return _pairs(spark, sf_dir).select("vec_id", *flat(Q.conjugate(q), "c"), *flat(Q.negate(q), "n"), r6(Q.dot(q, r)).alias("dot"), r6(F.sqrt(Q.dot(q, q))).alias("norm"))


def q03_frame_change(spark, sf_dir):
    q = quat(spark, sf_dir).withColumn("c", Q.to_camera(F.col("q")))
    return q.select("vec_id", *flat(F.col("c"), "c"), *flat(Q.to_sensor(F.col("c")), "b"))


def q04_to_euler(spark, sf_dir):
    return quat(spark, sf_dir).select("vec_id", *(r6(Q.euler(F.col("q"))[k]).alias(k) for k in ("yaw", "pitch", "roll")))


def q05_from_euler(spark, sf_dir):
    v = F.col("vec_id")
    return quat(spark, sf_dir).select("vec_id", *flat(Q.from_euler((v % 360).cast("double"), (v % 170 - 85).cast("double"), (v % 350 - 175).cast("double")), "e"))


def q06_axis_angle(spark, sf_dir):
    return quat(spark, sf_dir).select("vec_id", *flat(Q.axis_angle((1.0, 2.0, 2.0), (F.col("vec_id") % 360).cast("double")), "a"))


def q07_log_map(spark, sf_dir):
    return quat(spark, sf_dir).select("vec_id", *flat(Q.rotation_vector(F.col("q")), "v", "xyz"))


def q08_exp_map(spark, sf_dir):
    v = F.col("vec_id")
    return quat(spark, sf_dir).select("vec_id", *flat(Q.from_rotation_vector(Q.vec((v % 90).cast("double"), (v % 70).cast("double") - 35, (v % 11).cast("double"))), "e"))


def q09_soft_limit(spark, sf_dir):
    v = F.col("vec_id")
    return quat(spark, sf_dir).select("vec_id", *flat(Q.soft_limited(Q.vec((v % 9).cast("double"), (v % 7).cast("double"), (v % 5).cast("double")), 4.0), "l", "xyz"))


def q10_unwrap(spark, sf_dir):
    e = quat(spark, sf_dir).withColumn("yaw", F.round(Q.euler(F.col("q"))["yaw"], 6))
    return e.select("clip_id", "vec_id", r6(W.unwrapped("yaw", ["clip_id"], "vec_id")).alias("yaw"))


def q11_constant_rotation(spark, sf_dir):
    return quat(spark, sf_dir).select("vec_id", *flat(Q.product((0.5, 0.5, -0.5, 0.5), F.col("q")), "r"))


def q13_rays(spark, sf_dir):
    q = quat(spark, sf_dir).select("vec_id", F.col("q.x").alias("u"), F.col("q.y").alias("v"))
    n = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v") + 1)
    return q.select("vec_id", r6(F.col("u") / n).alias("rx"), r6(F.col("v") / n).alias("ry"), r6(1 / n).alias("rz"))


def q14_axis_rates(spark, sf_dir):
    w = Window.partitionBy("clip_id").orderBy("vec_id")
    q = quat(spark, sf_dir).select("clip_id", "vec_id", "q", "t", F.coalesce(F.lag("q").over(w), F.col("q")).alias("a"), F.coalesce(F.lag("t").over(w), F.col("t")).alias("ta"), F.lag("t").over(w).isNull().alias("head"), F.lead("q", 1).over(w).alias("b1"), F.lead("t", 1).over(w).alias("tb1"), F.lead("q", 2).over(w).alias("b2"), F.lead("t", 2).over(w).alias("tb2"))
    b, tb = (F.coalesce(F.when(F.col("head"), F.col(f"{k}2")), F.col(f"{k}1"), F.col(o)) for k, o in (("b", "q"), ("tb", "t")))
    dt = (tb - F.col("ta")) / 1e6
    step = Q.increment(F.col("a"), b)
    return q.select("clip_id", "vec_id", *(r6(F.when(dt > 0, step[k] / dt).otherwise(0.0)).alias(f"r{k}") for k in "xyz"))


def q17_collapse(spark, sf_dir):
    e = quat(spark, sf_dir).select("clip_id", "vec_id", F.floor(F.col("q.w") * 2).cast("int").alias("level"))
    before = F.lag("level").over(Window.partitionBy("clip_id").orderBy("vec_id"))
    return e.withColumn("_b", before).where("_b is null or _b <> level").drop("_b")


def q18_signed_permutation(spark, sf_dir):
    q = F.col("q")
    return quat(spark, sf_dir).select("vec_id", r6(-q["y"]).alias("px"), r6(q["z"]).alias("py"), r6(-q["x"]).alias("pz"))


def q19_gain_shapes(spark, sf_dir):
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("vec_id") % 120) / 100.0))
    return quat(spark, sf_dir).select("vec_id", r6(0.2 + 0.8 * F.pow(x, F.lit(1.5))).alias("gain"), r6(x * x * x * (10 - 15 * x + 6 * x * x)).alias("smoother"))


def q20_rate_weight(spark, sf_dir):
    rate = (F.col("vec_id") % 300).cast("double")
    return quat(spark, sf_dir).select("vec_id", r6(1 / (1 + (rate / 120) * (rate / 120))).alias("weight"))


def t02_sign_continuity(spark, sf_dir):
    w = Window.partitionBy("clip_id").orderBy("vec_id")
    d = Q.dot(F.col("q"), F.lag("q").over(w))
    # the distance of unit quaternions is above 1.5 where 2 - 2d > 2.25
    q = quat(spark, sf_dir).withColumn("flip", F.when(2 - 2 * d > 2.25, 1).otherwise(0))
    q = q.withColumn("odd", F.sum("flip").over(w.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1)
    return q.select("clip_id", "vec_id", F.col("odd").alias("inverted"), *(r6(F.when(F.col("odd"), -F.col("q")[k]).otherwise(F.col("q")[k])).alias(f"s{k}") for k in "wxyz"))


def _instants(q: DataFrame) -> DataFrame:
    """Every sample's time less 300, exact sample times at multiples of 5, and times beyond both ends."""
    v = F.col("vec_id")
    own = q.select("clip_id", "vec_id", F.when(v % 5 == 0, F.col("t")).otherwise(F.col("t") - 300).alias("t"))
    ends = q.groupBy("clip_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return own.union(ends.select("clip_id", F.lit(-1).cast("long"), F.col("a") - 5000)).union(ends.select("clip_id", F.lit(-2).cast("long"), F.col("b") + 5000))


_ASKED = """asked AS (SELECT clip_id, vec_id, CASE WHEN vec_id % 5 = 0 THEN t ELSE t - 300 END AS t FROM s
    UNION ALL SELECT clip_id, -1, min(t) - 5000 FROM s GROUP BY clip_id UNION ALL SELECT clip_id, -2, max(t) + 5000 FROM s GROUP BY clip_id)"""


def _segment_sql(value: str, strict: bool) -> str:
    return f"""segs AS (SELECT clip_id, t AS own, coalesce(lead(t) OVER w, t) AS t1, coalesce(lead({value}) OVER w, {value}) AS v1, CASE WHEN lead(t) OVER w IS NULL THEN lag(t) OVER w ELSE t END AS t0, CASE WHEN lead(t) OVER w IS NULL THEN lag({value}) OVER w ELSE {value} END AS v0 FROM s WINDOW w AS (PARTITION BY clip_id ORDER BY t)),
    firsts AS (SELECT clip_id, arg_min(t0, own) AS t0, arg_min(v0, own) AS v0, arg_min(t1, own) AS t1, arg_min(v1, own) AS v1 FROM segs GROUP BY clip_id),
    met AS (SELECT a.clip_id, a.vec_id, a.t, coalesce(g.t0, f.t0) AS t0, coalesce(g.v0, f.v0) AS v0, coalesce(g.t1, f.t1) AS t1, coalesce(g.v1, f.v1) AS v1
        FROM asked a ASOF LEFT JOIN segs g ON a.clip_id = g.clip_id AND a.t {'>' if strict else '>='} g.own JOIN firsts f ON a.clip_id = f.clip_id),
    weighted AS (SELECT *, greatest(0, least(1, (t - t0) / (t1 - t0))) AS k FROM met)"""


def j01_asof_slerp(spark, sf_dir):
    q = quat(spark, sf_dir)
    return asof.slerped(q.select("clip_id", "t", "q"), _instants(q), ["clip_id"], "t", "q").select("clip_id", "vec_id", r6(F.col("t")).alias("t"), *flat(F.col("q"), "q"))


def j02_linear_join(spark, sf_dir):
    q = quat(spark, sf_dir)
    s = q.select("clip_id", "t", F.col("q.x").alias("x"))
    return asof.interpolated(s, _instants(q), ["clip_id"], "t", "x").select("clip_id", "vec_id", r6(F.col("x")).alias("x"))


def w01_frame_increments(spark, sf_dir):
    q = quat(spark, sf_dir)
    ends = q.groupBy("clip_id").agg(F.max("t").alias("b"))
    grid = ends.select("clip_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("b") / 20000).cast("int"))).alias("frame")).withColumn("t", F.col("frame") * F.lit(20000.0))
    at = asof.slerped(q.select("clip_id", "t", "q"), grid, ["clip_id"], "t", "q")
    step = Q.increment(F.col("q"), F.lead("q").over(Window.partitionBy("clip_id").orderBy("frame")))
    return at.select("clip_id", "frame", step.alias("v")).where("v.x is not null").select("clip_id", "frame", *flat(F.col("v"), "d", "xyz"))


def w21_rotation_over_gap(spark, sf_dir):
    q = quat(spark, sf_dir).withColumn("r", F.lead("q", 5).over(Window.partitionBy("clip_id").orderBy("vec_id"))).where("r is not null")
    return q.select("clip_id", "vec_id", *flat(Q.increment(F.col("q"), F.col("r")), "g", "xyz"))


def _log(q: str) -> str:
    n = f"sqrt(({q}).x*({q}).x+({q}).y*({q}).y+({q}).z*({q}).z)"
    turn = f"2*atan2({n}, ({q}).w)"
    k = f"degrees(CASE WHEN {n} > 1e-12 THEN (CASE WHEN {turn} > pi() THEN {turn} - 2*pi() ELSE {turn} END)/{n} ELSE 2.0 END)"
    return f"struct_pack(x := ({q}).x*{k}, y := ({q}).y*{k}, z := ({q}).z*{k})"


def _step_sql(a: str, b: str, source: str, keep: str) -> str:
    """p2: keep and e, the increment from a to b in source."""
    return f"""fl AS (SELECT {keep}, {a} AS qa, CASE WHEN {a}.w*{b}.w+{a}.x*{b}.x+{a}.y*{b}.y+{a}.z*{b}.z < 0 THEN struct_pack(w := -{b}.w, x := -{b}.x, y := -{b}.y, z := -{b}.z) ELSE {b} END AS qb FROM {source}),
    cj AS (SELECT {keep}, struct_pack(w := qa.w, x := -qa.x, y := -qa.y, z := -qa.z) AS ca, qb FROM fl),
    p2 AS (SELECT {keep}, {_log('m')} AS e FROM (SELECT {keep}, {q_mul('ca', 'qb')} AS m FROM cj))"""


_SLERP = """dots AS (SELECT *, v0.w*v1.w+v0.x*v1.x+v0.y*v1.y+v0.z*v1.z AS d FROM weighted),
    arcs AS (SELECT *, acos(least(1, abs(d))) AS g, CASE WHEN d < 0 THEN -1 ELSE 1 END AS sg FROM dots),
    ks AS (SELECT *, CASE WHEN g < 1e-7 THEN 1 - k ELSE sin((1 - k) * g) / sin(g) END AS ka, sg * CASE WHEN g < 1e-7 THEN k ELSE sin(k * g) / sin(g) END AS kb FROM arcs),
    mixed AS (SELECT *, v0.w*ka+v1.w*kb AS mw, v0.x*ka+v1.x*kb AS mx, v0.y*ka+v1.y*kb AS my, v0.z*ka+v1.z*kb AS mz FROM ks),
    slerped AS (SELECT *, struct_pack(w := mw/n, x := mx/n, y := my/n, z := mz/n) AS q FROM (SELECT *, sqrt(mw*mw+mx*mx+my*my+mz*mz) AS n FROM mixed))"""

_CONST = "struct_pack(w := {}::DOUBLE, x := {}::DOUBLE, y := {}::DOUBLE, z := {}::DOUBLE)".format
_FRAME = f"""WITH {QUAT}, s AS (SELECT vec_id, struct_pack(w := w, x := x, y := y, z := z) AS q, {_CONST(0.5, -0.5, -0.5, 0.5)} AS d, {_CONST(0, 0, 1, 0)} AS f, {_CONST(0.5, 0.5, 0.5, -0.5)} AS di, {_CONST(0, 0, -1, 0)} AS fi FROM quat),
    a AS (SELECT *, {q_mul('q', 'd')} AS m FROM s), b AS (SELECT *, {q_mul('f', 'm')} AS c FROM a), c1 AS (SELECT *, {q_mul('fi', 'c')} AS n FROM b), d1 AS (SELECT *, {q_mul('n', 'di')} AS k FROM c1)"""
_EULER = "degrees(atan2(2*(w*z+x*y), 1-2*(y*y+z*z)))", "degrees(asin(greatest(-1.0, least(1.0, 2*(w*y-z*x)))))", "degrees(atan2(2*(w*x+y*z), 1-2*(x*x+y*y)))"

ORACLE = {
    "q01_product": f"{_NEXT} SELECT vec_id, {sflat('m', 'p')} FROM (SELECT vec_id, {q_mul('q', 'r')} AS m FROM p)",
    "q02_conj_dot_norm": f"{_NEXT} SELECT vec_id, {s6('q.w')} AS cw, {s6('-q.x')} AS cx, {s6('-q.y')} AS cy, {s6('-q.z')} AS cz, {', '.join(f'{s6(f"-q.{k}")} AS n{k}' for k in 'wxyz')}, {s6('q.w*r.w+q.x*r.x+q.y*r.y+q.z*r.z')} AS dot, {s6('sqrt(q.w*q.w+q.x*q.x+q.y*q.y+q.z*q.z)')} AS norm FROM p",
    "q03_frame_change": f"{_FRAME} SELECT vec_id, {sflat('c', 'c')}, {sflat('k', 'b')} FROM d1",
    "q04_to_euler": f"WITH {QUAT} SELECT vec_id, {s6(_EULER[0])} AS yaw, {s6(_EULER[1])} AS pitch, {s6(_EULER[2])} AS roll FROM quat",
    "q05_from_euler": f"""WITH h AS (SELECT vec_id, cos(radians(vec_id % 360)/2) AS cy, sin(radians(vec_id % 360)/2) AS sy, cos(radians(vec_id % 170 - 85)/2) AS cp, sin(radians(vec_id % 170 - 85)/2) AS sp, cos(radians(vec_id % 350 - 175)/2) AS cr, sin(radians(vec_id % 350 - 175)/2) AS sr FROM embeddings)
        SELECT vec_id, {s6('cr*cp*cy+sr*sp*sy')} AS ew, {s6('sr*cp*cy-cr*sp*sy')} AS ex, {s6('cr*sp*cy+sr*cp*sy')} AS ey, {s6('cr*cp*sy-sr*sp*cy')} AS ez FROM h""",
    "q06_axis_angle": f"SELECT vec_id, {s6('cos(radians(vec_id % 360)/2)')} AS aw, {s6('sin(radians(vec_id % 360)/2)/3')} AS ax, {s6('sin(radians(vec_id % 360)/2)*2/3')} AS ay, {s6('sin(radians(vec_id % 360)/2)*2/3')} AS az FROM embeddings",
    "q07_log_map": f"{_NEXT} SELECT vec_id, {sflat(_log('q'), 'v', 'xyz')} FROM p",
    "q08_exp_map": f"""WITH v AS (SELECT vec_id, (vec_id % 90)::DOUBLE AS x, (vec_id % 70)::DOUBLE - 35 AS y, (vec_id % 11)::DOUBLE AS z FROM embeddings), n AS (SELECT *, sqrt(x*x+y*y+z*z) AS n FROM v)
        SELECT vec_id, {s6('cos(radians(n)/2)')} AS ew, {', '.join(f'{s6(f"{k} * CASE WHEN n > 1e-12 THEN sin(radians(n)/2)/n ELSE pi()/360 END")} AS e{k}' for k in 'xyz')} FROM n""",
    "q09_soft_limit": f"""WITH v AS (SELECT vec_id, (vec_id % 9)::DOUBLE AS x, (vec_id % 7)::DOUBLE AS y, (vec_id % 5)::DOUBLE AS z FROM embeddings), n AS (SELECT *, sqrt(x*x+y*y+z*z)/4 AS r FROM v)
        SELECT vec_id, {', '.join(f'{s6(f"{k} * CASE WHEN r > 0 THEN tanh(r)/r ELSE 1 END")} AS l{k}' for k in 'xyz')} FROM n""",
    "q10_unwrap": f"""WITH {QUAT}, e AS (SELECT clip_id, vec_id, round({_EULER[0]}, 6) AS yaw FROM quat), d AS (SELECT *, coalesce(round((yaw - lag(yaw) OVER w) / 360), 0) AS k FROM e WINDOW w AS (PARTITION BY clip_id ORDER BY vec_id))
        SELECT clip_id, vec_id, {s6('yaw - 360 * sum(k) OVER (PARTITION BY clip_id ORDER BY vec_id)')} AS yaw FROM d""",
    "q11_constant_rotation": f"{_NEXT} SELECT vec_id, {sflat('m', 'r')} FROM (SELECT vec_id, {q_mul('k', 'q')} AS m FROM (SELECT *, {_CONST(0.5, 0.5, -0.5, 0.5)} AS k FROM p))",
    "q13_rays": f"WITH {QUAT} SELECT vec_id, {s6('x/sqrt(x*x+y*y+1)')} AS rx, {s6('y/sqrt(x*x+y*y+1)')} AS ry, {s6('1/sqrt(x*x+y*y+1)')} AS rz FROM quat",
    "q14_axis_rates": f"""WITH {QUAT}, s AS (SELECT clip_id, vec_id, t, struct_pack(w := w, x := x, y := y, z := z) AS q, row_number() OVER (PARTITION BY clip_id ORDER BY vec_id) AS n, count(*) OVER (PARTITION BY clip_id) AS m FROM quat),
        i AS (SELECT *, greatest(n - 1, 1) AS lo, least(greatest(n - 1, 1) + 2, m) AS hi FROM s), pr AS (SELECT i.clip_id, i.vec_id, a.q AS q0, b.q AS q1, (b.t - a.t) / 1e6 AS dt FROM i JOIN s a ON a.clip_id = i.clip_id AND a.n = lo JOIN s b ON b.clip_id = i.clip_id AND b.n = hi),
        {_step_sql('q0', 'q1', 'pr', 'clip_id, vec_id, dt')} SELECT clip_id, vec_id, {', '.join(f'{s6(f"CASE WHEN dt > 0 THEN e.{k} / dt ELSE 0 END")} AS r{k}' for k in 'xyz')} FROM p2""",
    "q17_collapse": f"WITH {QUAT}, e AS (SELECT clip_id, vec_id, floor(w * 2)::INTEGER AS level FROM quat) SELECT clip_id, vec_id, level FROM (SELECT *, lag(level) OVER (PARTITION BY clip_id ORDER BY vec_id) AS b FROM e) WHERE b IS NULL OR b <> level",
    "q18_signed_permutation": f"WITH {QUAT} SELECT vec_id, {s6('-y')} AS px, {s6('z')} AS py, {s6('-x')} AS pz FROM quat",
    "q19_gain_shapes": f"SELECT vec_id, {s6('0.2 + 0.8 * pow(x, 1.5)')} AS gain, {s6('x*x*x*(10 - 15*x + 6*x*x)')} AS smoother FROM (SELECT vec_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (vec_id % 120) / 100.0::DOUBLE)) AS x FROM embeddings)",
    "q20_rate_weight": f"SELECT vec_id, {s6('1 / (1 + r * r)')} AS weight FROM (SELECT vec_id, (vec_id % 300) / 120.0::DOUBLE AS r FROM embeddings)",
    "t02_sign_continuity": f"""WITH {QUAT}, f AS (SELECT *, CASE WHEN 2 - 2 * (w*lag(w) OVER v + x*lag(x) OVER v + y*lag(y) OVER v + z*lag(z) OVER v) > 2.25 THEN 1 ELSE 0 END AS flip FROM quat WINDOW v AS (PARTITION BY clip_id ORDER BY vec_id)),
        o AS (SELECT *, sum(flip) OVER (PARTITION BY clip_id ORDER BY vec_id) % 2 = 1 AS odd FROM f) SELECT clip_id, vec_id, odd AS inverted, {', '.join(f'{s6(f"CASE WHEN odd THEN -{k} ELSE {k} END")} AS s{k}' for k in 'wxyz')} FROM o""",
    "j01_asof_slerp": f"{_NEXT}, {_ASKED}, {_segment_sql('q', True)}, {_SLERP} SELECT clip_id, vec_id, {s6('t')} AS t, {sflat('q', 'q')} FROM slerped",
    "j02_linear_join": f"{_NEXT}, {_ASKED}, {_segment_sql('q', False)} SELECT clip_id, vec_id, {s6('v0.x + (v1.x - v0.x) * k')} AS x FROM weighted",
    "w01_frame_increments": f"""{_NEXT}, ends AS (SELECT clip_id, max(t) AS b FROM s GROUP BY clip_id), asked AS (SELECT clip_id, k AS vec_id, k * 20000.0::DOUBLE AS t FROM (SELECT clip_id, unnest(range(0, floor(b / 20000)::BIGINT + 1)) AS k FROM ends)),
        {_segment_sql('q', True)}, {_SLERP}, st AS (SELECT clip_id, vec_id, q AS q0, lead(q) OVER (PARTITION BY clip_id ORDER BY vec_id) AS q1 FROM slerped), st2 AS (SELECT * FROM st WHERE q1 IS NOT NULL), {_step_sql('q0', 'q1', 'st2', 'clip_id, vec_id')}
        SELECT clip_id, vec_id::INTEGER AS frame, {sflat('e', 'd', 'xyz')} FROM p2""",
    "w21_rotation_over_gap": f"{_NEXT}, g5 AS (SELECT clip_id, vec_id, q, lead(q, 5) OVER (PARTITION BY clip_id ORDER BY vec_id) AS r5 FROM p), g6 AS (SELECT * FROM g5 WHERE r5 IS NOT NULL), {_step_sql('q', 'r5', 'g6', 'clip_id, vec_id')} SELECT clip_id, vec_id, {sflat('e', 'g', 'xyz')} FROM p2",
}

QUERIES = {name: globals()[name] for name in ORACLE}
