"""Queries over timing, retiming, applied corrections, scans and small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quaternion as Q
from ..operators import asof
from ..operators import islands as I
from ..operators import windows as W
from .events import _SPANS, _spans
from .rotations import _EULER, _NEXT, _SLERP, _ASKED, _instants, _segment_sql
from .series import _FILL, _SEC, K, _runs, _seconds, _w, j11_nearest_in_time
from .views import DUO, QUAT, SIG, duo, flat, q_mul, quat, r6, s6, sflat, sig, table


def t05_exposure_fill(spark, sf_dir):
    d = duo(spark, sf_dir)
    return d.select("clip_id", "frame", r6(W.filled("ix", K, "frame")).alias("exposure_ms"), F.col("ix").isNull().alias("was_missing"))


def t07_reference_shift(spark, sf_dir):
    """Shift of a reference slot against the read instant; missing slots are at the series' median."""
    d = duo(spark, sf_dir)
    slot = F.coalesce("ix", F.percentile("ix", F.lit(0.5)).over(Window.partitionBy("clip_id")))
    n, off = F.col("event_id") % 5 + 1, F.col("rate") / 400
    return d.select("clip_id", "frame", r6((slot - (off + n * 9000.0 / 20000.0)) / n * 20.0).alias("shift_ms"))


def _retimed(spark, sf_dir) -> DataFrame:
    q = quat(spark, sf_dir)
    frame = F.floor(F.col("vec_id") / 5)
    late = q.select("clip_id", "vec_id", (F.col("t") + (frame % 7 - 3) * 100.0).alias("t"))
    return asof.slerped(q.select("clip_id", "t", "q"), late, ["clip_id"], "t", "q")


def t09_retime(spark, sf_dir):
    return _retimed(spark, sf_dir).select("clip_id", "vec_id", *flat(F.col("q"), "q"))


def c05_apply_correction(spark, sf_dir):
    """The retimed attitude with each frame's correction about its own z, in the sensor's frame."""
    turn = (F.floor(F.col("vec_id") / 5) % 5).cast("double") * 0.1
    fixed = Q.let(Q.product(F.col("q"), Q.from_rotation_vector(Q.vec(0.0, 0.0, turn))), Q.normalized)
    return _retimed(spark, sf_dir).select("clip_id", "vec_id", fixed.alias("q")).select("clip_id", "vec_id", *flat(Q.to_sensor(F.col("q")), "s"))


def j07_resample(spark, sf_dir):
    """Values at instants of another grid; instants beyond the samples are left out and counted."""
    q = quat(spark, sf_dir)
    s = q.select("clip_id", "t", F.col("q.y").alias("y"))
    ends = s.groupBy("clip_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    asked = _instants(q).join(ends, "clip_id").where("t between lo and hi").select("clip_id", "vec_id", "t")
    return asof.interpolated(s, asked, K, "t", "y").select("clip_id", "vec_id", r6(F.col("y")).alias("y"))


def a03_timing_scan(spark, sf_dir):
    """The shift of one sensor against the other with the least distance, refined by a parabola, and how clear it is.

    25 shifts of half a frame, between frames on the line between them; the last 8 frames don't count, and
    a series of fewer than 200 frames that do has no shift. The gain is that of the frames as they stand.
    """
    d = duo(spark, sf_dir).select("clip_id", "frame", "x", "ix")
    end = d.groupBy("clip_id").agg(F.max("frame").alias("end"))
    # each shift reads the frames beside a frame in its chunk: no row is there once for each shift
    beside = {k: (F.lag if k < 0 else F.lead)("x", abs(k)) for k in range(-6, 8)}
    d = W.framed(d, K, "frame", 6, 7, {f"_x{k}": (lambda _, w, c=c: c.over(w)) for k, c in beside.items()})
    used = d.join(end, "clip_id").where("ix is not null and frame <= end - 8")
    fit = used.groupBy("clip_id").agg(F.regr_slope("ix", "x").alias("g"), F.count(F.lit(1)).alias("used"))
    at = lambda k: F.col(f"_x{k // 2}") if k % 2 == 0 else (F.col(f"_x{k // 2}") + F.col(f"_x{k // 2 + 1}")) / 2
    e = {k: F.col("ix") - F.col("g") * at(k) for k in range(-12, 13)}
    sums = used.join(fit, "clip_id").groupBy("clip_id").agg(F.max("used").alias("used"), F.max("frame").alias("last"), *(F.round(F.sqrt(F.avg(v * v)), 6).alias(f"_r{k}") for k, v in e.items()))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"_r{k}").alias("r")) for k in e)))
    # a shift counts if one of the frames that count has a frame there
    cost = sums.select("clip_id", "used", "last", each.alias("c")).select("clip_id", "used", "c.*", (F.col("last") + F.floor(F.col("c.k") / 2) >= 0).alias("met")).where("met").drop("met")
    by = Window.partitionBy("clip_id").orderBy("k")
    cost = cost.withColumn("a", F.lag("r").over(by)).withColumn("b", F.lead("r").over(by))
    best = cost.groupBy("clip_id").agg(F.min(F.struct("r", "k", "a", "b")).alias("m"), F.max(F.when(F.col("k") == 0, F.col("r"))).alias("r0"), F.max("used").alias("used"))
    den = F.col("m.a") - 2 * F.col("m.r") + F.col("m.b")
    bend = F.when(den > 0, (F.col("m.a") - F.col("m.b")) / (2 * den)).otherwise(0.0)  # null at the ends of the scan
    depth, enough = (F.col("r0") - F.col("m.r")) / F.col("r0"), F.col("used") >= 200
    shift = F.when(enough, (F.col("m.k") + F.coalesce(bend, F.lit(0.0))) / 2).otherwise(0.0)
    return best.select("clip_id", F.col("m.k").alias("k"), r6(shift).alias("shift"), (enough & (depth >= 0.003)).alias("clear"), "used")


def a07_defect_gate(spark, sf_dir):
    """Per frame: a ramp of the median of the nearest calm seconds times a ramp of the series' median, on lines
    between the middles of the seconds."""
    ramp = lambda v, lo, hi: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / (hi - lo)))
    s = _seconds(spark, sf_dir)
    calm = s.where("busy < 17").groupBy("clip_id").agg(F.percentile("m", F.lit(0.5)).alias("mid"))
    near = j11_nearest_in_time(spark, sf_dir)
    by = s.select("clip_id", "second").join(near, ["clip_id", "second"], "left").join(calm, "clip_id", "left")
    by = by.select("clip_id", "second", F.coalesce(ramp(F.col("median"), 0.4, 0.6) * ramp(F.col("mid"), 0.2, 0.6), F.lit(0.0)).alias("g"))
    w = Window.partitionBy("clip_id").orderBy("second")
    by = by.withColumn("next", F.coalesce(F.lead("g").over(w), F.col("g"))).withColumn("first", F.first("g").over(w))
    place = F.col("frame") / 50 - 0.5
    f = sig(spark, sf_dir).select("clip_id", "frame", F.greatest(F.floor(place), F.lit(0)).cast("int").alias("second"), F.greatest(place, F.lit(0.0)).alias("place"))
    return f.join(by, ["clip_id", "second"]).select("clip_id", "frame", r6(F.col("g") + (F.col("next") - F.col("g")) * (F.col("place") - F.col("second"))).alias("gate"))


def a27_adaptive_scale(spark, sf_dir):
    v = lambda k: (F.col("event_id") % k + 1).cast("double")
    soft = lambda c, most: most * (1 - F.exp(-c / most))
    scale = soft(v(7), 5.0) * soft(v(5) / 4, 1.0) * F.pow(v(3) / 3, F.lit(0.5)) / (1 + v(11) / 20)
    return sig(spark, sf_dir).select("event_id", r6(F.greatest(F.lit(0.1), F.least(F.lit(2.0), scale))).alias("scale"))


def a28_scale_scan(spark, sf_dir):
    """Of 19 scales that whose two gains are nearest to one, the residual deciding between like ones, refined by a parabola.

    It is trusted inside the scan if both gains come within 15 %; else the scale stays one.
    """
    d = duo(spark, sf_dir).where("ix is not null").select("clip_id", "x", "y", "ix", "iy", F.explode(F.sequence(F.lit(0), F.lit(18))).alias("k"))
    s = 0.6 + 0.05 * F.col("k")
    off = lambda a: F.col(f"i{a}") * s - F.col(a)
    gain = lambda a: F.round(F.regr_slope(F.col(f"i{a}") * s, F.col(a)), 6).alias(f"g{a}")
    g = d.groupBy("clip_id", "k").agg(gain("x"), gain("y"), F.round(F.percentile(F.sqrt(off("x") * off("x") + off("y") * off("y")), F.lit(0.5)), 6).alias("res"))
    g = g.withColumn("least", F.min("res").over(Window.partitionBy("clip_id")))
    cost = F.pow(F.col("gx") - 1, F.lit(2.0)) + F.pow(F.col("gy") - 1, F.lit(2.0)) + 0.1 * F.pow(F.col("res") / F.greatest(F.col("least"), F.lit(1e-6)), F.lit(2.0))
    by = Window.partitionBy("clip_id").orderBy("k")
    g = g.withColumn("cost", F.round(cost, 6)).withColumn("a", F.lag("cost").over(by)).withColumn("b", F.lead("cost").over(by))
    best = g.groupBy("clip_id").agg(F.min(F.struct("cost", "k", "a", "b", "gx", "gy")).alias("m"))
    den = F.col("m.a") - 2 * F.col("m.cost") + F.col("m.b")
    scale = 0.6 + 0.05 * (F.col("m.k") + F.coalesce(F.when(den > 0, (F.col("m.a") - F.col("m.b")) / (2 * den)), F.lit(0.0)))
    near = F.greatest(F.abs(F.col("m.gx") - 1), F.abs(F.col("m.gy") - 1)) < 0.15
    trusted = near & F.col("m.k").between(1, 17)
    return best.select("clip_id", "m.k", F.col("m.gx").alias("gain_x"), F.col("m.gy").alias("gain_y"), trusted.alias("trusted"), r6(F.when(trusted, scale).otherwise(1.0)).alias("scale"))


def a29_consensus(spark, sf_dir):
    """The median of seven fits of each second - one to all its rows, six to subsets of about 70 % -, their spread, and
    whether they agree: at least five fits, and a spread of less than a tenth in both axes."""
    d = duo(spark, sf_dir).where("ix is not null").select("clip_id", F.floor(F.col("frame") / 50).cast("int").alias("pair"), "event_id", "x", "y", "ix", "iy", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k"))
    each = d.where((F.col("k") == 0) | ((F.col("event_id") * 31 + F.col("k") * 17) % 10 < 7))
    fits = each.groupBy("clip_id", "pair", "k").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.regr_slope(f"i{a}", a), 6).alias(a) for a in "xy")).where("n >= 20 and x is not null and y is not null")
    own = Window.partitionBy("clip_id", "pair")
    mid = fits.select("*", *(F.percentile(a, F.lit(0.5)).over(own).alias(f"m{a}") for a in "xy"))
    g = mid.groupBy("clip_id", "pair").agg(F.count(F.lit(1)).alias("support"), *(F.max(f"m{a}").alias(f"median_{a}") for a in "xy"), *((1.4826 * F.percentile(F.abs(F.col(a) - F.col(f"m{a}")), F.lit(0.5))).alias(f"s{a}") for a in "xy"))
    spread = F.round(F.greatest("sx", "sy"), 6)
    return g.select("clip_id", "pair", "support", r6(F.col("median_x")).alias("median_x"), r6(F.col("median_y")).alias("median_y"), r6(spread).alias("spread"), ((F.col("support") >= 5) & (spread < 0.1)).alias("reliable"))


def i03_ranges(spark, sf_dir):
    runs = I.islands(sig(spark, sf_dir).where("x >= 2.5"), K, "frame", 3, F.min("us").alias("t0"), F.max("us").alias("t1"))
    return runs.select("clip_id", "first", "last", ((F.col("t1") - F.col("t0")) / 1000000).alias("seconds"))


def i16_keyframes(spark, sf_dir):
    """The last key frame at or before a span's start and the first at or after its end."""
    key = sig(spark, sf_dir).where("event_id % 11 = 0").select("clip_id", F.col("frame").alias("key"))
    at = lambda span_end, name, f: f.select("clip_id", "run", "a", "b", F.col(span_end).alias("frame"), F.lit(name).alias("end"))
    spans = _spans(spark, sf_dir)
    rows = at("a", "a", spans).union(at("b", "b", spans)).select("clip_id", "frame", F.lit(1).alias("s"), "run", "a", "b", "end", F.lit(None).cast("int").alias("key"))
    keys = key.select("clip_id", F.col("key").alias("frame"), F.lit(0).alias("s"), F.lit(None).cast("int").alias("run"), F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"), F.lit(None).cast("string").alias("end"), "key")
    by = Window.partitionBy("clip_id").orderBy("frame", "s")
    back = Window.partitionBy("clip_id").orderBy(F.col("frame").desc(), "s")
    met = keys.union(rows).withColumn("before", F.last("key", ignorenulls=True).over(by)).withColumn("after", F.last("key", ignorenulls=True).over(back)).where("run is not null")
    return met.groupBy("clip_id", "run").agg(F.max(F.when(F.col("end") == "a", F.col("before"))).alias("key_before"), F.max(F.when(F.col("end") == "b", F.col("after"))).alias("key_after"))


def q12_views(spark, sf_dir):
    e = Q.euler(F.col("q"))
    return quat(spark, sf_dir).select("vec_id", r6(F.col("t") / 1e6).alias("t_s"), r6(e["yaw"]).alias("yaw"), r6(e["pitch"]).alias("pitch"), r6(e["roll"]).alias("roll"))


def q22_helpers(spark, sf_dir):
    """Improvement in percent, and two unit vectors across a unit vector (Gram-Schmidt against an axis it isn't near)."""
    q = quat(spark, sf_dir).select("vec_id", "q", F.sqrt(F.col("q.x") * F.col("q.x") + F.col("q.y") * F.col("q.y") + F.col("q.z") * F.col("q.z")).alias("n")).where("n > 0")
    u = {k: F.col(f"q.{k}") / F.col("n") for k in "xyz"}
    q = q.select("vec_id", *(c.alias(k) for k, c in u.items()), F.col("q.w").alias("w"))
    steep = F.abs("x") < 0.9
    ax, ay = F.when(steep, 1.0).otherwise(0.0), F.when(steep, 0.0).otherwise(1.0)
    d = ax * F.col("x") + ay * F.col("y")
    raw = q.select("vec_id", "x", "y", "z", "w", (ax - d * F.col("x")).alias("px"), (ay - d * F.col("y")).alias("py"), (-d * F.col("z")).alias("pz"))
    m = F.sqrt(F.col("px") * F.col("px") + F.col("py") * F.col("py") + F.col("pz") * F.col("pz"))
    return raw.select("vec_id", *(r6(F.col(f"p{k}") / m).alias(f"b{k}") for k in "xyz"), r6(100 * F.try_divide(F.col("w") - F.col("x"), F.nullif(F.col("w"), F.lit(0.0)))).alias("improvement"))


def s23_recordings(spark, sf_dir):
    """Sequence and start from the names of split recordings, and their end by how long they are."""
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("REC_"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("_"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"), F.lit(".MP4"))
    n = o.select("o_orderkey", name.alias("name"), (F.col("o_orderkey") % 3600).alias("seconds"))
    pattern = r"^REC_(\d{14})_(\d{4})\.MP4$"
    start = F.to_timestamp(F.regexp_extract("name", pattern, 1), "yyyyMMddHHmmss")
    return n.select("o_orderkey", F.regexp_extract("name", pattern, 2).cast("int").alias("seq"), F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format(start + F.make_dt_interval(secs=F.col("seconds")), "yyyy-MM-dd HH:mm:ss").alias("end"))


def k13_parse_verify(spark, sf_dir):
    """Two readings of one series matched by number, the next or the one before: rows, missing and worst difference."""
    s = sig(spark, sf_dir)
    other = s.where("event_id % 9 <> 0").select("clip_id", F.col("frame").alias("key"), (F.col("x") + 1e-3 * (F.col("event_id") % 3)).alias("v"))
    tries = s.select("clip_id", "frame", "x", F.posexplode(F.array(F.col("frame"), F.col("frame") + 1, F.col("frame") - 1)).alias("turn", "key"))
    met = tries.join(other, ["clip_id", "key"], "left").groupBy("clip_id", "frame").agg(F.max("x").alias("x"), F.min_by("v", F.when(F.col("v").isNotNull(), F.col("turn"))).alias("v"))
    return met.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").isNull()).alias("missing"), r6(F.max(F.abs(F.col("x") - F.col("v")))).alias("worst"))


_LATE = "asked AS (SELECT clip_id, vec_id, t + ((vec_id // 5) % 7 - 3) * 100.0::DOUBLE AS t FROM s)"
_C = "struct_pack(w := {}::DOUBLE, x := {}::DOUBLE, y := {}::DOUBLE, z := {}::DOUBLE)".format

ORACLE = {
    "t05_exposure_fill": f"WITH {DUO}, {_FILL} SELECT clip_id, frame, {s6('v')} AS exposure_ms, ix IS NULL AS was_missing FROM full_",
    "t07_reference_shift": f"WITH {DUO}, m AS (SELECT clip_id, median(ix) AS m FROM duo GROUP BY clip_id) SELECT clip_id, frame, {s6('(coalesce(ix, m) - (rate / 400 + (event_id % 5 + 1) * 9000.0::DOUBLE / 20000)) / (event_id % 5 + 1) * 20')} AS shift_ms FROM duo JOIN m USING (clip_id)",
    "t09_retime": f"{_NEXT}, {_LATE}, {_segment_sql('q', True)}, {_SLERP} SELECT clip_id, vec_id, {sflat('q', 'q')} FROM slerped",
    "c05_apply_correction": f"""{_NEXT}, {_LATE}, {_segment_sql('q', True)}, {_SLERP}, e AS (SELECT clip_id, vec_id, q, radians((vec_id // 5) % 5 * 0.1::DOUBLE) / 2 AS h, {_C(0.5, 0.5, 0.5, -0.5)} AS di, {_C(0, 0, -1, 0)} AS fi FROM slerped),
        c1 AS (SELECT *, struct_pack(w := cos(h), x := 0.0::DOUBLE, y := 0.0::DOUBLE, z := sin(h)) AS r FROM e), c2 AS (SELECT *, {q_mul('q', 'r')} AS f FROM c1), c3 AS (SELECT *, {q_mul('fi', 'f')} AS g FROM c2), c4 AS (SELECT clip_id, vec_id, {q_mul('g', 'di')} AS s FROM c3)
        SELECT clip_id, vec_id, {sflat('s', 's')} FROM c4""",
    "j07_resample": f"""{_NEXT}, {_ASKED.replace('asked AS', 'asked0 AS')}, asked AS (SELECT a.* FROM asked0 a JOIN (SELECT clip_id, min(t) AS lo, max(t) AS hi FROM s GROUP BY clip_id) e USING (clip_id) WHERE a.t BETWEEN lo AND hi), {_segment_sql('q', False)}
        SELECT clip_id, vec_id, {s6('v0.y + (v1.y - v0.y) * k')} AS y FROM weighted""",
    "a03_timing_scan": f"""WITH {DUO}, e AS (SELECT *, max(frame) OVER (PARTITION BY clip_id) AS last_, lead(x) OVER (PARTITION BY clip_id ORDER BY frame) AS next FROM duo), u AS (SELECT * FROM e WHERE ix IS NOT NULL AND frame <= last_ - 8), g AS (SELECT clip_id, regr_slope(ix, x) AS g, count(*) AS used FROM u GROUP BY clip_id),
        c AS (SELECT a.clip_id, k::INTEGER AS k, used, round(sqrt(avg((a.ix - g * CASE WHEN k % 2 = 0 THEN b.x ELSE (b.x + b.next) / 2 END) ** 2)), 6) AS r FROM u a, range(-12, 13) t(k), e b, g WHERE b.clip_id = a.clip_id AND g.clip_id = a.clip_id AND b.frame = a.frame + floor(k / 2.0::DOUBLE) GROUP BY ALL),
        n AS (SELECT *, lag(r) OVER (PARTITION BY clip_id ORDER BY k) AS a, lead(r) OVER (PARTITION BY clip_id ORDER BY k) AS b FROM c), m AS (SELECT clip_id, min({{'r': r, 'k': k, 'a': a, 'b': b}}) AS m, max(r) FILTER (k = 0) AS r0, max(used) AS used FROM n GROUP BY clip_id)
        SELECT clip_id, m.k AS k, {s6('CASE WHEN used >= 200 THEN (m.k + coalesce(CASE WHEN m.a - 2 * m.r + m.b > 0 THEN (m.a - m.b) / (2 * (m.a - 2 * m.r + m.b)) ELSE 0 END, 0)) / 2 ELSE 0 END')} AS shift, used >= 200 AND (r0 - m.r) / r0 >= 0.003 AS clear, used FROM m""",
    "a07_defect_gate": f"""{_SEC}, near AS (SELECT s.clip_id, s.second, o.m, row_number() OVER (PARTITION BY s.clip_id, s.second ORDER BY abs(s.second - o.second), o.second) AS k FROM s JOIN s o ON o.clip_id = s.clip_id AND o.busy < 17 AND abs(o.second - s.second) <= 20),
        n AS (SELECT clip_id, second, {s6('median(m)')} AS med FROM near WHERE k <= 7 GROUP BY ALL HAVING count(*) >= 5), m AS (SELECT clip_id, median(m) AS mid FROM s WHERE busy < 17 GROUP BY clip_id),
        g AS (SELECT s.clip_id, s.second, coalesce(greatest(0, least(1, (med - 0.4::DOUBLE) / (0.6::DOUBLE - 0.4::DOUBLE))) * greatest(0, least(1, (mid - 0.2::DOUBLE) / (0.6::DOUBLE - 0.2::DOUBLE))), 0) * CASE WHEN med IS NULL THEN 0 ELSE 1 END AS g FROM s LEFT JOIN n USING (clip_id, second) LEFT JOIN m USING (clip_id)),
        l AS (SELECT *, coalesce(lead(g) OVER (PARTITION BY clip_id ORDER BY second), g) AS next FROM g), f AS (SELECT clip_id, frame, greatest(frame / 50.0::DOUBLE - 0.5::DOUBLE, 0) AS place FROM sig)
        SELECT f.clip_id, frame, {s6('g + (next - g) * (place - second)')} AS gate FROM f JOIN l ON l.clip_id = f.clip_id AND l.second = floor(place)""",
    "a27_adaptive_scale": f"SELECT event_id, {s6('greatest(0.1::DOUBLE, least(2.0::DOUBLE, 5 * (1 - exp(-(event_id % 7 + 1) / 5.0::DOUBLE)) * (1 - exp(-(event_id % 5 + 1) / 4.0::DOUBLE)) * sqrt((event_id % 3 + 1) / 3.0::DOUBLE) / (1 + (event_id % 11 + 1) / 20.0::DOUBLE)))')} AS scale FROM events",
    "a28_scale_scan": f"""WITH {DUO}, d AS (SELECT clip_id, k::INTEGER AS k, x, iy * s AS jy, ix * s AS jx, b_y AS yy FROM (SELECT clip_id, x, y AS b_y, ix, iy, k, 0.6::DOUBLE + 0.05::DOUBLE * k AS s FROM duo, range(0, 19) t(k) WHERE ix IS NOT NULL)),
        g AS (SELECT clip_id, k, round(regr_slope(jx, x), 6) AS gx, round(regr_slope(jy, yy), 6) AS gy, round(median(sqrt((jx - x) ** 2 + (jy - yy) ** 2)), 6) AS res FROM d GROUP BY ALL),
        c AS (SELECT *, round((gx - 1) ** 2 + (gy - 1) ** 2 + 0.1::DOUBLE * (res / greatest(min(res) OVER (PARTITION BY clip_id), 1e-6::DOUBLE)) ** 2, 6) AS cost FROM g), n AS (SELECT *, lag(cost) OVER (PARTITION BY clip_id ORDER BY k) AS a, lead(cost) OVER (PARTITION BY clip_id ORDER BY k) AS b FROM c),
        m AS (SELECT clip_id, min({{'cost': cost, 'k': k, 'a': a, 'b': b, 'gx': gx, 'gy': gy}}) AS m FROM n GROUP BY clip_id), t AS (SELECT *, greatest(abs(m.gx - 1), abs(m.gy - 1)) < 0.15::DOUBLE AND m.k BETWEEN 1 AND 17 AS trusted FROM m)
        SELECT clip_id, m.k AS k, m.gx AS gain_x, m.gy AS gain_y, trusted, {s6('CASE WHEN trusted THEN 0.6::DOUBLE + 0.05::DOUBLE * (m.k + coalesce(CASE WHEN m.a - 2 * m.cost + m.b > 0 THEN (m.a - m.b) / (2 * (m.a - 2 * m.cost + m.b)) END, 0)) ELSE 1 END')} AS scale FROM t""",
    "a29_consensus": f"""WITH {DUO}, f AS (SELECT clip_id, (frame // 50)::INTEGER AS pair, k, round(regr_slope(ix, x), 6) AS vx, round(regr_slope(iy, y), 6) AS vy FROM duo, range(0, 7) t(k) WHERE ix IS NOT NULL AND (k = 0 OR (event_id * 31 + k * 17) % 10 < 7) GROUP BY ALL HAVING count(*) >= 20 AND regr_slope(ix, x) IS NOT NULL AND regr_slope(iy, y) IS NOT NULL),
        m AS (SELECT *, median(vx) OVER w AS mx, median(vy) OVER w AS my FROM f WINDOW w AS (PARTITION BY clip_id, pair)), g AS (SELECT clip_id, pair, count(*) AS support, max(mx) AS mx, max(my) AS my, round(greatest(1.4826::DOUBLE * median(abs(vx - mx)), 1.4826::DOUBLE * median(abs(vy - my))), 6) AS spread FROM m GROUP BY ALL)
        SELECT clip_id, pair, support, {s6('mx')} AS median_x, {s6('my')} AS median_y, {s6('spread')} AS spread, support >= 5 AND spread < 0.1 AS reliable FROM g""",
    "i03_ranges": f"WITH {SIG}, f AS (SELECT * FROM sig WHERE x >= 2.5), {_runs('f', 3, ', min(us) AS t0, max(us) AS t1')} SELECT clip_id, first, last, (t1 - t0) / 1000000::DOUBLE AS seconds FROM r",
    "i16_keyframes": f"{_SPANS}, k AS (SELECT clip_id, frame AS key FROM sig WHERE event_id % 11 = 0) SELECT p.clip_id, run::INTEGER AS run, max(key) FILTER (key <= a) AS key_before, min(key) FILTER (key >= b) AS key_after FROM spans p LEFT JOIN k ON k.clip_id = p.clip_id GROUP BY ALL",
    "q12_views": f"WITH {QUAT} SELECT vec_id, {s6('t / 1e6::DOUBLE')} AS t_s, {s6(_EULER[0])} AS yaw, {s6(_EULER[1])} AS pitch, {s6(_EULER[2])} AS roll FROM quat",
    "q22_helpers": f"""WITH {QUAT}, u AS (SELECT vec_id, w, x / n AS x, y / n AS y, z / n AS z FROM (SELECT vec_id, w, x, y, z, sqrt(x*x+y*y+z*z) AS n FROM quat) WHERE n > 0), a AS (SELECT *, CASE WHEN abs(x) < 0.9 THEN 1.0::DOUBLE ELSE 0 END AS ax, CASE WHEN abs(x) < 0.9 THEN 0.0::DOUBLE ELSE 1 END AS ay FROM u),
        p AS (SELECT *, ax - (ax*x+ay*y)*x AS px, ay - (ax*x+ay*y)*y AS py, -(ax*x+ay*y)*z AS pz FROM a) SELECT vec_id, {', '.join(f'{s6(f"p{k}/sqrt(px*px+py*py+pz*pz)")} AS b{k}' for k in 'xyz')}, {s6('100 * (w - x) / nullif(w, 0)')} AS improvement FROM p""",
    "s23_recordings": "SELECT o_orderkey, (o_orderkey % 10000)::INTEGER AS seq, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS start, strftime(o_orderdate + to_seconds(o_orderkey % 3600), '%Y-%m-%d %H:%M:%S') AS end FROM orders",
    "k13_parse_verify": f"""WITH {SIG}, o AS (SELECT clip_id, frame AS key, x + 1e-3::DOUBLE * (event_id % 3) AS v FROM sig WHERE event_id % 9 <> 0), m AS (SELECT s.clip_id, s.frame, max(s.x) AS x, arg_min(o.v, turn) FILTER (o.v IS NOT NULL) AS v FROM sig s CROSS JOIN (VALUES (0, 0), (1, 1), (2, -1)) t(turn, d) LEFT JOIN o ON o.clip_id = s.clip_id AND o.key = s.frame + d GROUP BY ALL)
        SELECT clip_id, count(*) AS n, count_if(v IS NULL)::BIGINT AS missing, {s6('max(abs(x - v))')} AS worst FROM m GROUP BY clip_id""",
}

QUERIES = {name: globals()[name] for name in ORACLE}
