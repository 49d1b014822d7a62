"""Queries over corrections put together from windows, runs and joins, and over comparisons of two readings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import quaternion as Q
from ..operators import corrections as C
from ..operators import islands as I
from ..operators import spikes
from .rotations import _EULER
from .series import _FILL, _MED, _SPIKES, K, _padded, _runs
from .views import DUO, QUAT, SIG, duo, flat, q_mul, quat, r6, s6, sig

PER_FRAME = 5


def i25_bursts(spark, sf_dir):
    """The angle that takes each burst of disagreement away and is nothing at its ends; elsewhere there is none."""
    d = duo(spark, sf_dir).select("clip_id", "frame", (F.col("ix") - F.col("x")).alias("gap"), "rate")
    found = C.burst_angle(d, K, "frame", "gap", "rate", least=0.4, soft_rate=40.0, rate_max=200.0, margin=8, gap_rows=5)
    return found.select("clip_id", "frame", F.round("angle", 10).alias("angle"))


def i14_controls(spark, sf_dir):
    """Two stretches of 60 frames without a high value within five frames, at starts every ten frames, far apart."""
    busy = I.islands(sig(spark, sf_dir).where("x >= 2.5"), K, "frame", 0).select("clip_id", (F.col("first") - 5).alias("a"), (F.col("last") + 5).alias("b"))
    return C.control_segments(sig(spark, sf_dir), busy, K, "frame", length=60, step=10, edge=50, count=2)


def a20_bootstrap(spark, sf_dir):
    """The ratio of two readings' root mean squares, with 95 % of 2000 resamples of stretches of 100 frames, and a mark."""
    d = duo(spark, sf_dir).where("ix is not null").select("clip_id", F.floor(F.col("frame") / 100).cast("int").alias("block"), F.round(F.col("x") * F.col("x"), 8).alias("a"), F.round(F.col("ix") * F.col("ix"), 8).alias("b"))
    found = C.block_bootstrap(d, K, "block", "a", "b", 2000)
    return found.select("clip_id", r6(F.col("ratio")).alias("ratio"), r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"), "mark")


def m11_confidence(spark, sf_dir):
    """How far a picture's motion is to be trusted: by the points that it rests on, not at all where a channel is missing."""
    support = F.col("event_id") % 450
    seen = F.col("ix").isNotNull() & F.col("iy").isNotNull() & F.col("iz").isNotNull()
    return duo(spark, sf_dir).select("event_id", support.alias("support"), r6(F.when(seen, F.least(support / 300.0, F.lit(1.0))).otherwise(0.0)).alias("confidence"))


def m13_channels(spark, sf_dir):
    """Of three sources of a series the first that it has at all, and its axes by the known map."""
    d = duo(spark, sf_dir)
    pick = F.length("clip_id") % 3
    d = d.select("clip_id", "frame", *(F.when(pick == 0, F.col(f"i{a}")).alias(f"p{a}") for a in "xyz"), F.when(pick == 1, F.col("ix") * 2).alias("second"), F.col("x").alias("third"))
    one = Window.partitionBy("clip_id")
    d = d.withColumn("has1", F.max(F.col("px").isNotNull()).over(one)).withColumn("has2", F.max(F.col("second").isNotNull()).over(one))
    source = F.when(F.col("has1"), "pair").when(F.col("has2"), "normal").otherwise("raw")
    roll = F.when(F.col("has1"), F.col("pz")).when(F.col("has2"), F.col("second")).otherwise(F.col("third"))
    return d.select("clip_id", "frame", source.alias("source"), r6(-F.col("px")).alias("x"), r6(F.col("py")).alias("y"), r6(roll).alias("roll"))


def r04_vectors(spark, sf_dir):
    """All axes without gaps; a series with fewer than two values on an axis is an error."""
    d = duo(spark, sf_dir)
    full = C.whole(d, K, "frame", ["ix", "iy", "iz"])
    return full.select("clip_id", "frame", *(r6(F.col(k)).alias(k) for k in ("ix", "iy", "iz")))


def k07_trim_verify(spark, sf_dir):
    """A cut of a series against the series: packets missing and new, bodies that differ, and whether times moved alike."""
    s = sig(spark, sf_dir)
    cut = s.where("frame >= 300 and event_id % 211 <> 0").select("clip_id", (F.col("frame") - 300).alias("frame"), (F.col("us") - 5000).alias("us"), F.round(F.col("x") + F.when(F.col("event_id") % 307 == 0, 1.0).otherwise(0.0), 6).alias("x"))
    want = s.where("frame >= 300").select("clip_id", (F.col("frame") - 300).alias("frame"), "us", F.round("x", 6).alias("x"))
    return C.compared(want, cut, K, ["frame"], ["x"], "us")


def k14_local_edit(spark, sf_dir):
    """Edits that should lie in spans: rows that changed outside, rows that changed inside, and rotations that are not whole."""
    q = quat(spark, sf_dir)
    edited = q.select("clip_id", "vec_id", F.when(F.col("vec_id") % 37 < 4, Q.negate(F.col("q"))).when(F.col("vec_id") % 101 == 0, Q.quat(F.col("q.w") * 2, F.col("q.x"), F.col("q.y"), F.col("q.z"))).otherwise(F.col("q")).alias("e"))
    met = q.join(edited, ["clip_id", "vec_id"])
    changed = F.col("q.w") != F.col("e.w")
    inside = F.col("vec_id") % 37 < 3
    whole = F.abs(F.sqrt(Q.dot(F.col("e"), F.col("e"))) - 1) < 2e-7
    return met.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(changed & ~inside).alias("outside"), F.count_if(changed & inside).alias("inside"), F.count_if(~whole).alias("broken"))


def k16_runs_compared(spark, sf_dir):
    """Two runs of a detector: root mean squares, how many events each has, and those that are gone and new."""
    s = sig(spark, sf_dir)
    a, b = (I.islands(s.where(f"x >= {least}"), K, "frame", gap).select("clip_id", "first", "last") for least, gap in ((1.6, 1), (1.5, 1)))
    met = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), ["clip_id", "first", "last"], "full")
    events = met.groupBy("clip_id").agg(F.count("a").alias("n_before"), F.count("b").alias("n_after"), F.count_if(F.col("b").isNull()).alias("gone"), F.count_if(F.col("a").isNull()).alias("new"))
    rms = s.groupBy("clip_id").agg(*(r6(F.sqrt(F.avg(F.when(F.col("x") >= least, F.col("x") * F.col("x")).otherwise(0.0)))).alias(n) for n, least in (("rms_before", 1.6), ("rms_after", 1.5))))
    return events.join(rms, "clip_id").withColumn("unchanged", (F.col("gone") == 0) & (F.col("new") == 0) & (F.abs(F.col("rms_before") - F.col("rms_after")) < 1e-9))


def k17_cache_validity(spark, sf_dir):
    """Which cached measurements may be used: long enough, values up to their end, of that file and with that lens."""
    d = duo(spark, sf_dir)
    end = F.max("frame").over(Window.partitionBy("clip_id"))
    m = d.withColumn("end", end).groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("frame") > F.col("end") - F.greatest(F.lit(10), F.floor(F.col("end") / 20)), F.col("ix").isNotNull())).alias("ends"))
    entries = m.select("clip_id", F.concat(F.lit("/clips/"), F.upper("clip_id"), F.lit(".MP4")).alias("path"), (F.length("clip_id") % 2 == 0).alias("own_lens"))
    cached = m.select("clip_id", "n", "ends", F.concat(F.lit("d:/"), F.when(F.length("clip_id") == 5, F.lit("other")).otherwise(F.col("clip_id")), F.lit(".mp4")).alias("video"), F.when(F.length("clip_id") % 4 == 0, "profile").otherwise("clip metadata").alias("lens"))
    name = lambda c: F.lower(F.element_at(F.split(c, "/"), -1))
    met = entries.join(cached, "clip_id", "left")
    lens = (F.col("lens") != "clip metadata") == F.col("own_lens")
    return met.select("clip_id", (F.coalesce("n", F.lit(0)) > 100).alias("long_enough"), F.coalesce("ends", F.lit(False)).alias("complete"), (name("path") == name("video")).alias("same_file"), lens.alias("same_lens"))


def s17_edits(spark, sf_dir):
    """Edited rotations by frame and index, from three kinds of columns: as stored, in the camera's frame, or as angles. Where
    the sign of the sample had been turned, it is turned back; other samples keep theirs."""
    q = quat(spark, sf_dir).select("clip_id", F.floor(F.col("vec_id") / PER_FRAME).alias("frame"), F.col("vec_id") % PER_FRAME, F.col("vec_id"), "q").toDF("clip_id", "frame", "index", "vec_id", "q")
    samples = q.withColumn("inverted", F.col("vec_id") % 3 == 0)
    edits = q.where("vec_id % 4 < 3").select("clip_id", "frame", "index", F.element_at(F.array(F.lit("stored"), F.lit("camera"), F.lit("angles")), (F.col("vec_id") % 4 + 1).cast("int")).alias("kind"), F.col("q").alias("stored"), Q.to_camera(F.col("q")).alias("camera"), F.struct(*((F.col("vec_id") % k - k / 2).alias(n) for n, k in (("yaw", 90.0), ("pitch", 60.0), ("roll", 40.0)))).alias("angles"))
    return C.edited(samples, edits, ["clip_id", "frame", "index"]).select("vec_id", "edited", *flat(F.col("q"), "q"))


def c14_euler_bridge(spark, sf_dir):
    """Inside each stretch of 20 samples two angles leave their course for a smooth bridge between its ends, faded in and out."""
    e = quat(spark, sf_dir).select("clip_id", "vec_id", "t", Q.euler(F.col("q")).alias("e"))
    w = Window.partitionBy("clip_id").orderBy("vec_id")
    e = e.select("clip_id", "t", (F.row_number().over(w) - 1).alias("k"), "vec_id", *(F.col(f"e.{n}").alias(n) for n in ("yaw", "pitch", "roll")))
    d = e.withColumn("span", F.floor(F.col("k") / 20))
    found = C.bridged(d, ["clip_id", "span"], "t", ["yaw", "roll"], fade=30000.0)
    return found.select("vec_id", *(F.round(n, 8).alias(n) for n in ("yaw", "pitch", "roll")))


def _events(spark, sf_dir, model: str):
    d = spikes.unconfirmed(duo(spark, sf_dir), K, "frame", ["x", "y"], ["ix", "iy"], "rate")
    d = d.select("clip_id", "frame", "x", "y", "rate", "spike", "contaminated", (F.col("ix") - F.col("x")).alias("gx"), (F.col("iy") - F.col("y")).alias("gy"), (F.col("event_id") % 5 != 0).alias("reliable"))
    return C.event_correction(d, K, "frame", ["gx", "gy"], ["x", "y"], "reliable", "rate", 0.2, 51, ratio=0.1, rate_max=300.0, model=model)


def i07_event_correction(spark, sf_dir):
    found, _ = _events(spark, sf_dir, "image")
    return found.select("clip_id", "frame", F.round("c_x", 10).alias("cx"), F.round("c_y", 10).alias("cy"))


def i07_events(spark, sf_dir):
    _, events = _events(spark, sf_dir, "image")
    return events.select("clip_id", "a", "b", r6(F.col("peak")).alias("peak"), r6(F.col("mean_rate")).alias("mean_rate"), "spike")


def i07_bridges(spark, sf_dir):
    found, _ = _events(spark, sf_dir, "bridge")
    return found.select("clip_id", "frame", F.round("c_x", 10).alias("cx"), F.round("c_y", 10).alias("cy"))


def i09_window_disagreement(spark, sf_dir):
    """Two estimates of the motion against what the sensor told, by each of the three ways to join them."""
    d = duo(spark, sf_dir)
    wobble = (F.col("event_id") % 7 - 3) / F.lit(40.0)
    d = d.select("clip_id", "frame", "event_id", "x", "y", F.col("ix").alias("ax"), F.col("iy").alias("ay"), (F.col("ix") * 1.05 + wobble).alias("bx"), (F.col("iy") * 0.95 - wobble).alias("by"))
    usable = F.col("event_id") % 450 >= 30
    found = [C.window_disagreement(d, K, "frame", ["x", "y"], ["ax", "ay"], ["bx", "by"], usable, 51, e) for e in ("mean", "max", "min")]
    told = found[0].select("clip_id", "frame", "reliable", F.round("d_x", 10).alias("mean_x"), F.round("d_y", 10).alias("mean_y"))
    for name, f in zip(("max", "min"), found[1:]):
        told = told.join(f.select("clip_id", "frame", F.round("d_x", 10).alias(f"{name}_x"), F.round("d_y", 10).alias(f"{name}_y")), ["clip_id", "frame"])
    return told


def _run_sql(name: str, source: str, gap: int) -> str:
    """_runs() under names of its own."""
    return _runs(source, gap).replace("n AS (SELECT *", f"{name}n AS (SELECT *").replace("r AS (SELECT clip_id, run", f"{name} AS (SELECT clip_id, run").replace("FROM n GROUP BY ALL", f"FROM {name}n GROUP BY ALL")


_FILLS = ", ".join(_FILL.replace("ix", k).replace("g AS", f"g{k} AS").replace("FROM g)", f"FROM g{k})").replace("full_", f"full{k}") for k in ("ix", "iy", "iz"))
_DERAMP = """h AS (SELECT *, row_number() OVER (PARTITION BY clip_id, run ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY clip_id, run) - 1 AS n FROM m),
    t AS (SELECT clip_id, run, frame, i, n, sum(v * CASE WHEN n > 0 THEN 0.5 - 0.5 * cos(2 * pi() * i / n) ELSE 1 END) OVER (PARTITION BY clip_id, run ORDER BY frame) AS s FROM h),
    th AS (SELECT clip_id, frame, s - CASE WHEN n > 0 THEN last_value(s) OVER (PARTITION BY clip_id, run ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * i / n ELSE 0 END AS v FROM t)"""
_Q4 = "struct_pack(w := {}, x := {}, y := {}, z := {})".format
_HALF = lambda k: f"radians((vec_id % {k} - {k} / 2.0::DOUBLE)) / 2"
_ZERO = "0.0::DOUBLE"
_SMOOTH = lambda u: f"((least(1, greatest(0, {u})) ** 3) * (least(1, greatest(0, {u})) * (least(1, greatest(0, {u})) * 6 - 15) + 10))"
_NEAR = lambda v, a: f"({a} + (((({v}) - ({a}) + 180) % 360) + 360) % 360 - 180)"


def _bridge_sql(n: str) -> str:
    v, b = _NEAR(n, f"a_{n}"), _NEAR(f"b_{n}", f"a_{n}")
    return f"round(CASE WHEN inner_ > 0 THEN {v} + {_SMOOTH('inner_ / 30000')} * (a_{n} + {_SMOOTH('(t - t0) / (t1 - t0)')} * ({b} - a_{n}) - {v}) ELSE {n} END, 8) AS {n}"


def _detail_sql(name: str, source: str, value: str, half: int = 25) -> str:
    """A value of source (null where unknown) less its running median, as table name (clip_id, frame, v, null where unknown)."""
    fill = _FILL.replace("g AS (", f"{name}g AS (").replace("FROM g)", f"FROM {name}g)").replace("full_", f"{name}f").replace("ix", value).replace("FROM duo", f"FROM {source}")
    pad = _padded(f"{name}f", "v", half).replace("pad AS", f"{name}p AS")
    return f"{fill}, {pad}, {name}m AS (SELECT *, {_MED('v', half, half)} AS m FROM {name}p), {name} AS (SELECT f.clip_id, f.frame, CASE WHEN f.{value} IS NOT NULL THEN f.v - m END AS v FROM {name}f f JOIN {name}m m USING (clip_id, frame) WHERE m.own)"


_GAPS = f"""{_SPIKES}, gp AS (SELECT clip_id, frame, ix - x AS dx, iy - y AS dy FROM nr), {_detail_sql('ex', 'gp', 'dx')}, {_detail_sql('ey', 'gp', 'dy')},
    q AS (SELECT n.clip_id, n.frame, n.x, n.y, rate, spike, contaminated, event_id % 5 <> 0 AS reliable, ex.v AS ex, ey.v AS ey, sqrt(coalesce(ex.v, 0) ** 2 + coalesce(ey.v, 0) ** 2) AS size FROM nr n JOIN ex USING (clip_id, frame) JOIN ey USING (clip_id, frame)),
    f AS (SELECT * FROM q WHERE spike OR (reliable AND ex IS NOT NULL AND ey IS NOT NULL AND size >= 0.2 AND rate < 300 AND size >= 0.1 * sqrt(x * x + y * y))), {_runs('f', 2, ', bool_or(spike) AS sp')},
    k AS (SELECT clip_id, first, last, sum(CASE WHEN first - pe - 1 > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY first) AS k FROM (SELECT *, max(last) OVER (PARTITION BY clip_id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM r WHERE n >= 2 OR sp)),
    ends AS (SELECT clip_id, min(frame) AS lo, max(frame) AS hi FROM q GROUP BY clip_id), ev AS (SELECT clip_id, k AS run, min(first) AS first, max(last) AS last FROM k GROUP BY ALL), w AS (SELECT ev.*, greatest(first - 3, lo) AS a, least(last + 3, hi) AS b FROM ev JOIN ends USING (clip_id)),
    m AS (SELECT q.*, w.run, w.a, w.b, w.first, w.last, least(frame - a + 1, b - frame + 1) AS step, least(3, (b - a + 1) // 2) AS edge FROM q JOIN w ON w.clip_id = q.clip_id AND q.frame BETWEEN a AND b),
    s AS (SELECT *, CASE WHEN step > edge THEN 1 ELSE 0.5::DOUBLE - 0.5::DOUBLE * cos(pi() * step / (edge + 1)) END AS soft FROM m)"""
_IMAGE = f"""{_GAPS}, i1 AS (SELECT *, CASE WHEN spike OR contaminated THEN 0 ELSE coalesce(ex, 0) END * soft AS sx, CASE WHEN spike OR contaminated THEN 0 ELSE coalesce(ey, 0) END * soft AS sy FROM s),
    i2 AS (SELECT *, avg(sx) FILTER (NOT spike) OVER (PARTITION BY clip_id, run) AS mx, avg(sy) FILTER (NOT spike) OVER (PARTITION BY clip_id, run) AS my FROM i1)"""
_CTX = lambda a, side: f"(SELECT avg(d.{a}) FROM q d WHERE d.clip_id = w.clip_id AND d.frame {side})"
_AT = lambda a, at: f"(SELECT d.{a} FROM q d WHERE d.clip_id = w.clip_id AND d.frame = {at})"
_BRIDGE = f"""{_GAPS}, b1 AS (SELECT clip_id, run, {', '.join(f"coalesce({_CTX(a, 'BETWEEN w.a - 10 AND w.a - 1')}, {_AT(a, 'w.a')}) AS u{a}, coalesce({_CTX(a, 'BETWEEN w.b + 1 AND w.b + 10')}, {_AT(a, 'w.b')}) AS v{a}" for a in 'xy')} FROM w),
    b2 AS (SELECT s.*, ux, uy, vx, vy, CASE WHEN b > a THEN (frame - a) / (b - a)::DOUBLE ELSE 0 END AS u FROM s JOIN b1 USING (clip_id, run))"""
_TWO = f"""WITH {DUO}, w0 AS (SELECT clip_id, frame, event_id, x, y AS y_, ix, iy, (event_id % 7 - 3) / 40.0::DOUBLE AS wob FROM duo), w1 AS (SELECT clip_id, frame, event_id % 450 >= 30 AND ix IS NOT NULL AS ok, ix - x AS ax, iy - y_ AS ay, ix * 1.05::DOUBLE + wob - x AS bx, iy * 0.95::DOUBLE - wob - y_ AS by_ FROM w0),
    w2 AS (SELECT clip_id, frame, ok, {', '.join(f'CASE WHEN ok THEN {c} END AS {n}' for c, n in (('ax', 'hh'), ('ay', 'hv'), ('bx', 'kh'), ('by_', 'kv')))} FROM w1), {', '.join(_detail_sql(f'z{n}', 'w2', n) for n in ('hh', 'hv', 'kh', 'kv'))},
    z AS (SELECT clip_id, frame, ok, zhh.v AS a1, zhv.v AS a2, zkh.v AS b1, zkv.v AS b2 FROM w2 JOIN zhh USING (clip_id, frame) JOIN zhv USING (clip_id, frame) JOIN zkh USING (clip_id, frame) JOIN zkv USING (clip_id, frame)),
    zn AS (SELECT *, sqrt(a1 * a1 + a2 * a2) AS na, sqrt(b1 * b1 + b2 * b2) AS nb FROM z)"""

ORACLE = {
    "i25_bursts": f"""WITH {DUO}, f AS (SELECT * FROM duo WHERE abs(ix - x) > 0.4 AND rate < 200), {_runs('f', 4)}, e AS (SELECT clip_id, min(frame) AS lo, max(frame) AS hi FROM duo GROUP BY clip_id), sp AS (SELECT clip_id, run, greatest(first - 8, lo) AS a, least(last + 8, hi) AS b FROM r JOIN e USING (clip_id)),
        m AS (SELECT d.clip_id, run, frame, coalesce(ix - x, 0) / (1 + (rate / 40) ** 2) AS v FROM duo d JOIN sp ON sp.clip_id = d.clip_id AND frame BETWEEN a AND b), {_DERAMP} SELECT clip_id, frame, round(sum(v), 10) AS angle FROM th GROUP BY ALL""",
    "i14_controls": f"""WITH {SIG}, f AS (SELECT * FROM sig WHERE x >= 2.5), e AS (SELECT clip_id, max(frame) AS hi FROM sig GROUP BY clip_id), st AS (SELECT clip_id, unnest(range(50, hi - 109, 10))::INTEGER AS start FROM e WHERE hi - 110 >= 50),
        free AS (SELECT * FROM st WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.clip_id = st.clip_id AND st.start BETWEEN f.frame - 64 AND f.frame + 5)), p AS (SELECT clip_id, min(start) AS a, max(start) AS b FROM free GROUP BY clip_id),
        s AS (SELECT clip_id, a AS start FROM p UNION ALL SELECT clip_id, b FROM p WHERE b - a >= 60) SELECT clip_id, start, start + 60 AS "end" FROM s""",
    "a20_bootstrap": f"""WITH {DUO}, d AS (SELECT clip_id, frame // 100 AS block, sum(round(x * x, 8)) AS a, sum(round(ix * ix, 8)) AS b FROM duo WHERE ix IS NOT NULL GROUP BY ALL), n AS (SELECT *, count(*) OVER (PARTITION BY clip_id) AS n, row_number() OVER (PARTITION BY clip_id ORDER BY block) - 1 AS j FROM d),
        w AS (SELECT n.clip_id, r, ('0x' || substr(md5(r || '-' || j), 1, 8))::BIGINT % n AS at FROM n, range(0, 2000) t(r)), v AS (SELECT w.clip_id, r, sqrt(sum(b) / greatest(sum(a), 1e-12)) AS v FROM w JOIN n ON n.clip_id = w.clip_id AND n.j = w.at GROUP BY ALL),
        i AS (SELECT clip_id, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM v GROUP BY clip_id), q AS (SELECT clip_id, sqrt(sum(b) / greatest(sum(a), 1e-12)) AS ratio FROM d GROUP BY clip_id)
        SELECT clip_id, {s6('ratio')} AS ratio, {s6('lo')} AS low, {s6('hi')} AS high, CASE WHEN hi < 0.97 THEN '+' WHEN lo > 1.03 THEN '-' ELSE ' ' END AS mark FROM q JOIN i USING (clip_id)""",
    "m11_confidence": f"WITH {DUO} SELECT event_id, event_id % 450 AS support, {s6('CASE WHEN ix IS NOT NULL THEN least(event_id % 450 / 300.0::DOUBLE, 1) ELSE 0 END')} AS confidence FROM duo",
    "m13_channels": f"""WITH {DUO} SELECT clip_id, frame, ['pair', 'normal', 'raw'][length(clip_id) % 3 + 1] AS source, {s6('CASE WHEN length(clip_id) % 3 = 0 THEN -ix END')} AS x, {s6('CASE WHEN length(clip_id) % 3 = 0 THEN iy END')} AS y,
        {s6('CASE length(clip_id) % 3 WHEN 0 THEN iz WHEN 1 THEN ix * 2 ELSE x END')} AS roll FROM (SELECT clip_id, frame, x, ix, iy, iz FROM duo)""",
    "r04_vectors": f"WITH {DUO}, {_FILLS} SELECT clip_id, frame, {s6('a.v')} AS ix, {s6('b.v')} AS iy, {s6('c.v')} AS iz FROM fullix a JOIN fulliy b USING (clip_id, frame) JOIN fulliz c USING (clip_id, frame)",
    "k07_trim_verify": f"WITH {SIG} SELECT clip_id, count_if(event_id % 211 <> 0)::BIGINT AS n, count_if(event_id % 211 = 0)::BIGINT AS missing, 0::BIGINT AS extra, count_if(event_id % 307 = 0 AND event_id % 211 <> 0)::BIGINT AS differ, -5000 AS shift FROM sig WHERE frame >= 300 GROUP BY clip_id",
    "k14_local_edit": "SELECT label AS clip_id, count(*) AS n, count_if(vec_id % 37 = 3 OR (vec_id % 101 = 0 AND vec_id % 37 >= 4))::BIGINT AS outside, count_if(vec_id % 37 < 3)::BIGINT AS inside, count_if(vec_id % 101 = 0 AND vec_id % 37 >= 4)::BIGINT AS broken FROM embeddings GROUP BY label",
    "k16_runs_compared": f"""WITH {SIG}, f1 AS (SELECT * FROM sig WHERE x >= 1.6), f2 AS (SELECT * FROM sig WHERE x >= 1.5), {_run_sql('r1', 'f1', 1)}, {_run_sql('r2', 'f2', 1)}, m AS (SELECT coalesce(r1.clip_id, r2.clip_id) AS clip_id, r1.run AS a, r2.run AS b FROM r1 FULL JOIN r2 ON r1.clip_id = r2.clip_id AND r1.first = r2.first AND r1.last = r2.last),
        c AS (SELECT clip_id, count(a) AS n_before, count(b) AS n_after, count_if(b IS NULL)::BIGINT AS gone, count_if(a IS NULL)::BIGINT AS new FROM m GROUP BY clip_id), q AS (SELECT clip_id, {s6('sqrt(avg(CASE WHEN x >= 1.6 THEN x * x ELSE 0 END))')} AS rms_before, {s6('sqrt(avg(CASE WHEN x >= 1.5 THEN x * x ELSE 0 END))')} AS rms_after FROM sig GROUP BY clip_id)
        SELECT *, gone = 0 AND new = 0 AND abs(rms_before - rms_after) < 1e-9 AS unchanged FROM c JOIN q USING (clip_id)""",
    "k17_cache_validity": f"""WITH {DUO}, e AS (SELECT *, max(frame) OVER (PARTITION BY clip_id) AS hi FROM duo) SELECT clip_id, count(*) > 100 AS long_enough, bool_or(ix IS NOT NULL AND frame > hi - greatest(10, hi // 20)) AS complete, length(clip_id) <> 5 AS same_file, (length(clip_id) % 4 = 0) = (length(clip_id) % 2 = 0) AS same_lens FROM e GROUP BY clip_id""",
    "s17_edits": f"""WITH {QUAT}, c AS (SELECT *, vec_id % 4 AS kind, vec_id % 3 = 0 AS inv, {_Q4(f'cos({_HALF(90)})', _ZERO, _ZERO, f'sin({_HALF(90)})')} AS yaw, {_Q4(f'cos({_HALF(60)})', _ZERO, f'sin({_HALF(60)})', _ZERO)} AS pitch, {_Q4(f'cos({_HALF(40)})', f'sin({_HALF(40)})', _ZERO, _ZERO)} AS roll,
        {_Q4('0.5::DOUBLE', '0.5::DOUBLE', '0.5::DOUBLE', '-0.5::DOUBLE')} AS di, {_Q4(_ZERO, _ZERO, '-1.0::DOUBLE', _ZERO)} AS fi FROM quat), c1 AS (SELECT *, {q_mul('pitch', 'roll')} AS pr FROM c), c2 AS (SELECT *, {q_mul('yaw', 'pr')} AS ypr FROM c1), c3 AS (SELECT *, {q_mul('fi', 'ypr')} AS g FROM c2), c4 AS (SELECT *, {q_mul('g', 'di')} AS a FROM c3),
        r AS (SELECT vec_id, kind < 3 AS edited, CASE WHEN kind = 2 THEN a ELSE struct_pack(w := w, x := x, y := y, z := z) END AS q, CASE WHEN kind IN (1, 2) AND inv THEN -1 ELSE 1 END AS sign FROM c4)
        SELECT vec_id, edited, {', '.join(f'{s6(f"q.{k} * sign")} AS q{k}' for k in 'wxyz')} FROM r""",
    "i07_event_correction": f"{_IMAGE} SELECT clip_id, frame, round(sum(sx - CASE WHEN spike THEN 0 ELSE mx END), 10) AS cx, round(sum(sy - CASE WHEN spike THEN 0 ELSE my END), 10) AS cy FROM i2 GROUP BY clip_id, frame",
    "i07_events": f"{_GAPS} SELECT clip_id, a, b, {s6('max(size) FILTER (frame BETWEEN first AND last)')} AS peak, {s6('avg(rate) FILTER (frame BETWEEN first AND last)')} AS mean_rate, bool_or(spike) AS spike FROM m GROUP BY clip_id, run, a, b",
    "i07_bridges": f"{_BRIDGE} SELECT clip_id, frame, round(sum((ux + (vx - ux) * u - x) * soft), 10) AS cx, round(sum((uy + (vy - uy) * u - y) * soft), 10) AS cy FROM b2 GROUP BY clip_id, frame",
    "i09_window_disagreement": f"""{_TWO} SELECT clip_id, frame, coalesce(ok AND a1 * b1 + a2 * b2 > 0 AND sqrt((a1 - b1) ** 2 + (a2 - b2) ** 2) <= 0.6 * greatest(na, nb) + 0.3, false) AS reliable, round((a1 + b1) / 2, 10) AS mean_x, round((a2 + b2) / 2, 10) AS mean_y,
        round(CASE WHEN na >= nb THEN a1 ELSE b1 END, 10) AS max_x, round(CASE WHEN na >= nb THEN a2 ELSE b2 END, 10) AS max_y, round(CASE WHEN na <= nb THEN a1 ELSE b1 END, 10) AS min_x, round(CASE WHEN na <= nb THEN a2 ELSE b2 END, 10) AS min_y FROM zn""",
    "c14_euler_bridge": f"""WITH {QUAT}, e AS (SELECT clip_id, vec_id, t, (row_number() OVER (PARTITION BY clip_id ORDER BY vec_id) - 1) // 20 AS span, {_EULER[0]} AS yaw, {_EULER[1]} AS pitch, {_EULER[2]} AS roll FROM quat),
        b AS (SELECT *, {', '.join(f'first_value({c}) OVER w AS a_{c}, last_value({c}) OVER w AS b_{c}' for c in ('yaw', 'roll'))}, first_value(t) OVER w AS t0, last_value(t) OVER w AS t1 FROM e WINDOW w AS (PARTITION BY clip_id, span ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        c AS (SELECT *, least(t - t0, t1 - t) AS inner_ FROM b) SELECT vec_id, {_bridge_sql('yaw')}, round(pitch, 8) AS pitch, {_bridge_sql('roll')} FROM c""",
}

QUERIES = {name: globals()[name] for name in ORACLE}
