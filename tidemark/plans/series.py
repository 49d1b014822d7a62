"""Queries over windows, runs and statistics of series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import islands as I
from ..operators import spikes, stats, timing
from ..operators import windows as W
from .views import DUO, SIG, duo, r6, s6, sig, table

K = ["clip_id"]


def _w():
    return Window.partitionBy("clip_id").orderBy("frame")


def w02_shifted_sum(spark, sf_dir):
    return sig(spark, sf_dir).select("clip_id", "frame", r6(W.cumulative_before(F.col("x"), K, "frame")).alias("total"))


def w03_running_rms(spark, sf_dir):
    win = 25
    d = W.framed(sig(spark, sf_dir), K, "frame", win // 2, (win - 1) // 2, {"s": lambda rows, _: F.sum(F.col("x") * F.col("x")).over(rows)})
    return d.select("clip_id", "frame", r6(F.sqrt(F.col("s") / win)).alias("rms"))


def w04_running_median(spark, sf_dir):
    return W.running_median(sig(spark, sf_dir), K, "frame", "x", 5, "m").select("clip_id", "frame", r6(F.col("m")).alias("median"))


def w05_detail(spark, sf_dir):
    d = duo(spark, sf_dir)
    full = d.select("clip_id", "frame", F.col("ix").alias("raw"), W.filled("ix", K, "frame").alias("v"))
    m = W.running_median(full.select("clip_id", "frame", "v"), K, "frame", "v", 51, "m")
    return full.select("clip_id", "frame", "raw").join(m, ["clip_id", "frame"]).select("clip_id", "frame", r6(F.when(F.col("raw").isNotNull(), F.col("v") - F.col("m"))).alias("detail"))


def w06_dilation(spark, sf_dir):
    s = sig(spark, sf_dir).withColumn("flag", F.col("event_id") % 53 == 0)
    d = W.framed(s, K, "frame", 4, 4, {"near": lambda rows, _: F.max(F.col("flag")).over(rows)})
    return d.select("clip_id", "frame", "near")


def w07_hit_count(spark, sf_dir):
    s = sig(spark, sf_dir).withColumn("flag", F.col("event_id") % 3 == 0)
    d = W.framed(s, K, "frame", 3, 2, {"hits": lambda rows, _: W.hits(F.col("flag"), rows)})  # an even window of six
    return d.select("clip_id", "frame", "hits", (F.col("hits") >= 3).alias("dense"))


def w08_differences(spark, sf_dir):
    x = F.col("x")
    first = F.lead(x).over(_w()) - x
    return sig(spark, sf_dir).select("clip_id", "frame", r6(first).alias("d1"), r6(F.lead(x).over(_w()) - 2 * x + F.lag(x).over(_w())).alias("d2"))


def w09_gap_fill(spark, sf_dir):
    return duo(spark, sf_dir).select("clip_id", "frame", r6(W.filled("ix", K, "frame")).alias("v"))


def w10_gradient(spark, sf_dir):
    s = sig(spark, sf_dir).withColumn("t", F.col("us") / 1e6 - 1.6e9)
    return s.select("clip_id", "frame", r6(W.gradient("x", "t", K, "frame")).alias("slope"))


def w11_leaky_release(spark, sf_dir):
    s = sig(spark, sf_dir)
    step = F.when(F.col("frame") > 0, (F.col("event_id") % 7 - 3).cast("double")).otherwise(0.0)
    d = W.leaky_release(s.withColumn("step", step).withColumn("held", F.col("event_id") % 5 == 0), K, "frame", "step", "held", 0.98, "y")
    return d.select("clip_id", "frame", r6(F.col("y")).alias("y"))


def w20_windowed_mean(spark, sf_dir):
    gap = 5
    d = W.framed(duo(spark, sf_dir), K, "frame", gap - 1, 0, {"m": lambda rows, _: F.avg("ix").over(rows), "good": lambda rows, _: F.count("ix").over(rows), "all": lambda rows, _: F.count(F.lit(1)).over(rows)})
    return d.select("clip_id", "frame", r6(F.col("m") / gap).alias("mean"), (F.col("good") >= F.greatest(F.lit(1.0), 0.6 * F.col("all"))).alias("reliable"))


def w22_excursion(spark, sf_dir):
    """How far the sums of a rate less its mean reach from nothing, over all three axes."""
    means = duo(spark, sf_dir).select("*", *(F.avg(k).over(Window.partitionBy("clip_id")).alias(f"m{k}") for k in "xyz"))
    run = means.select("clip_id", *((F.sum(F.col(k) - F.col(f"m{k}")).over(_w()) * 0.02).alias(k) for k in "xyz"))
    return run.groupBy("clip_id").agg(r6(F.max(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))).alias("excursion"))


def t04_frame_instants(spark, sf_dir):
    n = sig(spark, sf_dir).groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("clip_id", F.explode(F.sequence(F.lit(0), F.col("n").cast("int"))).alias("k")).select("clip_id", "k", F.round(F.col("k") * 1e6 / 59.94, 3).alias("t"))


def t06_frame_shift(spark, sf_dir):
    """The shift of each frame, in microseconds, by each of the four modes, with a bias of half a millisecond."""
    d = timing.frame_shifts(duo(spark, sf_dir), timing.MODES, K, "frame", "ix", 13.58, 0.5)
    return d.select("clip_id", "frame", *(r6(F.col(mode)).alias(mode) for mode in timing.MODES))


def t08_shifts(spark, sf_dir):
    """Each series' shifts by the mode that it asks for."""
    d = duo(spark, sf_dir).withColumn("mode", F.element_at(F.array(*map(F.lit, timing.MODES)), F.length("clip_id") % len(timing.MODES) + 1))
    each = (timing.frame_shifts(d.where(F.col("mode") == m), [m], K, "frame", "ix", 13.58).select("clip_id", "frame", "mode", r6(F.col(m)).alias("shift")) for m in timing.MODES)
    return reduce(DataFrame.union, each)


def _flagged(spark, sf_dir) -> DataFrame:
    return sig(spark, sf_dir).where("event_id % 7 < 2")


def i01_islands(spark, sf_dir):
    return I.islands(_flagged(spark, sf_dir), K, "frame", 2).select("clip_id", "run", "first", "last", F.col("n").cast("long").alias("n"))


def i02_islands_strict(spark, sf_dir):
    return I.islands(_flagged(spark, sf_dir), K, "frame", 0).select("clip_id", "run", "first", "last", F.col("n").cast("long").alias("n"))


def i04_merge_runs(spark, sf_dir):
    return I.merged(I.islands(_flagged(spark, sf_dir), K, "frame", 0), K, 2).select("clip_id", "first", "last", F.col("parts").cast("long").alias("parts"))


def i05_minimum_length(spark, sf_dir):
    runs = I.islands(_flagged(spark, sf_dir), K, "frame", 1, F.max(F.col("event_id") % 97 == 0).alias("marked"))
    return I.longer(runs, 3, F.col("marked")).select("clip_id", "first", "last", "marked")


def i06_spikes(spark, sf_dir):
    d = spikes.unconfirmed(duo(spark, sf_dir), K, "frame", ["x", "y"], ["ix", "iy"], "rate")
    return d.where("spike or contaminated").select("clip_id", "frame", r6(F.col("jump")).alias("jump"), "spike", "contaminated")


def flagship_unconfirmed_jumps(spark, sf_dir):
    """Stretches of each series with jumps that the second sensor does not confirm, their peak and where it is."""
    d = spikes.unconfirmed(duo(spark, sf_dir), K, "frame", ["x", "y"], ["ix", "iy"], "rate").where("spike")
    peak = F.max_by(F.struct("frame", "r_x", "r_y"), F.struct(F.round("jump", 6), -F.col("frame"))).alias("p")
    runs = I.islands(d, K, "frame", 2, F.max("jump").alias("jump"), peak)
    axis = F.when(F.abs("p.r_x") >= F.abs("p.r_y"), "x").otherwise("y")
    return runs.select("clip_id", "run", "first", "last", F.col("n").cast("long").alias("n"), r6(F.col("jump")).alias("peak"), F.col("p.frame").alias("peak_frame"), axis.alias("axis"))


def i12_event_find(spark, sf_dir):
    s = sig(spark, sf_dir).where("x >= 3")
    return I.islands(s, K, "frame", 5, F.max("x").alias("severity"), F.max_by("frame", F.struct("x", -F.col("frame"))).alias("at")).select("clip_id", "run", "first", "last", r6(F.col("severity")).alias("severity"), "at")


def i15_usable_window(spark, sf_dir):
    s = sig(spark, sf_dir)
    n = F.max("frame").over(Window.partitionBy("clip_id"))
    key = s.withColumn("n", n).where("event_id % 11 = 0 and frame >= 50 and frame <= n - 50")
    return key.groupBy("clip_id").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))


def i17_even_sample(spark, sf_dir):
    s = sig(spark, sf_dir)
    n = s.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"))
    picks = n.select("clip_id", "n", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k")).select("clip_id", F.bround(F.col("k") * (F.col("n") - 1) / 15).cast("int").alias("frame")).distinct()
    return s.join(picks, ["clip_id", "frame"]).select("clip_id", "frame", "event_id")


def i19_severity_ranking(spark, sf_dir):
    runs = I.islands(sig(spark, sf_dir).where("x >= 3"), K, "frame", 5, F.sum("x").alias("score"))
    w = Window.partitionBy("clip_id").orderBy(F.round("score", 6).desc(), "first")
    return runs.select("clip_id", "first", r6(F.col("score")).alias("score"), F.row_number().over(w).alias("place"))


def i20_worst_and_thinned(spark, sf_dir):
    w = Window.partitionBy("clip_id").orderBy(F.col("x").desc(), "frame")
    s = sig(spark, sf_dir).withColumn("place", F.row_number().over(w))
    return s.where("place <= 10 or frame % 40 = 0").select("clip_id", "frame", "place")


def i21_calm_stretch(spark, sf_dir):
    d = W.framed(sig(spark, sf_dir), K, "frame", 0, 59, {"m": lambda rows, _: F.avg("x").over(rows), "n": lambda rows, _: F.count(F.lit(1)).over(rows)})
    d = d.where("n = 60 and frame % 10 = 0")
    return d.groupBy("clip_id").agg(F.min(F.struct(F.round("m", 6).alias("m"), "frame")).alias("b")).select("clip_id", F.col("b.frame").alias("frame"), r6(F.col("b.m")).alias("mean"))


def a01_scalar_gain(spark, sf_dir):
    f = stats.scalar_gain(duo(spark, sf_dir), K, "x", "ix", (F.col("rate") >= 20) & (F.col("rate") <= 150), 200)
    return f.select("clip_id", r6(F.col("gain")).alias("gain"), r6(F.col("corr")).alias("corr"), F.col("n").cast("long").alias("n"))


def a02_axis_fit(spark, sf_dir):
    f = stats.plane_fit(duo(spark, sf_dir).where("ix is not null"), K, ("x", "y", "z"), "ix")
    return f.select("clip_id", *(r6(F.col(k)).alias(k) for k in "abc"))


def a05_mad_scale(spark, sf_dir):
    return stats.mad_scale(sig(spark, sf_dir), K, "x", 0.2).select("clip_id", r6(F.col("scale")).alias("scale"))


def a06_second_error(spark, sf_dir):
    d = duo(spark, sf_dir).withColumn("second", F.floor(F.col("frame") / 50).cast("int")).withColumn("e", F.abs(F.col("ix") - F.col("x")))
    calm = F.col("rate") < 200
    g = d.groupBy("clip_id", "second").agg((1.4826 * F.percentile(F.when(calm, F.col("e")), F.lit(0.5))).alias("error"), F.avg(F.when(calm, 1.0).otherwise(0.0)).alias("share"))
    return g.where("share > 0.5").select("clip_id", "second", r6(F.col("error")).alias("error"))


def _seconds(spark, sf_dir) -> DataFrame:
    return sig(spark, sf_dir).groupBy("clip_id", F.floor(F.col("frame") / 50).cast("int").alias("second")).agg(F.sum(F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)).alias("busy"), F.round(F.avg("x"), 6).alias("m"))


def j11_nearest_in_time(spark, sf_dir):
    """The median of the nearest 7 calm seconds within 20, of at least 5; nearer first, then earlier."""
    s = _seconds(spark, sf_dir)
    near = s.select("clip_id", "second", F.explode(F.sequence(F.col("second") - 20, F.col("second") + 20)).alias("other"))
    calm = s.where("busy < 17").select("clip_id", F.col("second").alias("other"), "m")
    met = near.join(calm, ["clip_id", "other"]).withColumn("k", F.row_number().over(Window.partitionBy("clip_id", "second").orderBy(F.abs(F.col("second") - F.col("other")), "other")))
    g = met.where("k <= 7").groupBy("clip_id", "second").agg(F.count(F.lit(1)).alias("n"), F.percentile("m", F.lit(0.5)).alias("m"))
    return g.where("n >= 5").select("clip_id", "second", r6(F.col("m")).alias("median"))


def a11_jitter_by_band(spark, sf_dir):
    d = duo(spark, sf_dir)
    band = F.when(F.col("rate") < 20, "calm").when(F.col("rate") < 60, "middle").otherwise("fast")
    d = d.withColumn("band", band)
    d = d.select("clip_id", "band", (F.lead("x").over(_w()) - F.col("x")).alias("d"), (F.lead("band").over(_w()) == F.col("band")).alias("both"))
    g = d.where("both and d is not null").groupBy("clip_id", "band").agg(F.count(F.lit(1)).cast("long").alias("n"), F.stddev_pop("d").alias("s"))
    return g.where("n > 5").select("clip_id", "band", "n", r6(F.col("s")).alias("jitter"))


def a12_disagreement(spark, sf_dir):
    d = duo(spark, sf_dir).where("ix is not null").withColumn("e", F.abs(F.col("ix") - F.col("x")))
    told = d.groupBy("clip_id").agg(r6(F.sqrt(F.avg(F.col("e") * F.col("e")))).alias("rms"), r6(F.percentile("e", F.lit(0.99))).alias("p99"), F.count_if(F.col("e") >= 1).cast("long").alias("over"))
    # frames of the largest disagreements, thinned so that some 40 to 79 are told
    high = d.where("e >= 1").join(told.select("clip_id", "over"), "clip_id").withColumn("i", F.row_number().over(_w()) - 1)
    thin = high.where(F.col("i") % F.greatest(F.floor(F.col("over") / 40), F.lit(1)) == 0).groupBy("clip_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("frame")), lambda f: f.cast("string")), " ").alias("frames"))
    return told.join(thin, "clip_id", "left")


def a17_verdict_rollup(spark, sf_dir):
    s = _seconds(spark, sf_dir).withColumn("verdict", F.when(F.col("m") >= 0.55, "worse").when(F.col("m") < 0.45, "better").otherwise("same"))
    kinds = [x for v in ("better", "same", "worse") for x in (F.count_if(F.col("verdict") == v).cast("long").alias(v), r6(F.avg(F.when(F.col("verdict") == v, F.col("m")))).alias(f"mean_{v}"))]
    return s.groupBy("clip_id").agg(*kinds, r6(F.avg("m")).alias("mean"), r6(F.percentile("m", F.lit(0.5))).alias("median"))


def a18_strength(spark, sf_dir):
    s, i = F.greatest(F.col("x") / 0.5, F.lit(1.0)), F.greatest(F.col("event_id") % 13 / 5.0, F.lit(1.0))
    v = 10 + 90 * (1 - F.exp(-0.65 * (F.sqrt(s * i) - 1)))
    v = F.greatest(F.lit(10.0), F.least(F.lit(100.0), v))
    d = sig(spark, sf_dir).select("event_id", F.round(v, 6).alias("strength"))
    level = F.when(F.col("strength") < 35, "weak").when(F.col("strength") < 65, "medium").when(F.col("strength") < 85, "strong").otherwise("extreme")
    return d.withColumn("level", level)


def a21_noise_model(spark, sf_dir):
    d = W.framed(sig(spark, sf_dir), K, "frame", 4, 0, {f"s{k}": (lambda rows, w, k=k: F.sum("x").over(w.rowsBetween(1 - k, 0))) for k in (1, 2, 3, 4, 5)})
    s = d.select("clip_id", F.posexplode(F.array(*(F.col(f"s{k}") for k in (1, 2, 3, 4, 5)))).alias("k", "v"))
    v = s.groupBy("clip_id", "k").agg(F.var_pop("v").alias("var"))
    return v.groupBy("clip_id").agg(r6(F.regr_slope("var", F.col("k") + 1)).alias("slope"), r6(F.regr_intercept("var", F.col("k") + 1)).alias("noise"))


def a22_rank_correlation(spark, sf_dir):
    p = Window.partitionBy("clip_id")
    s = _seconds(spark, sf_dir).withColumn("a", stats.ranks("busy", p)).withColumn("b", stats.ranks("m", p))
    bounds = _seconds(spark, sf_dir).groupBy("clip_id").agg(F.percentile("m", F.lit(0.9)).alias("worst"), F.percentile("busy", F.lit(0.8)).alias("top"))
    bad, told = F.col("m") >= F.col("worst"), F.col("busy") >= F.col("top")
    return s.join(bounds, "clip_id").groupBy("clip_id").agg(r6(F.corr("a", "b")).alias("spearman"), r6(F.count_if(bad & told) / F.count_if(bad)).alias("hit_rate"))


def a23_percentiles(spark, sf_dir):
    p = F.percentile("m", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99), F.lit(1.0)))
    s = _seconds(spark, sf_dir)
    worst = s.withColumn("k", F.row_number().over(Window.partitionBy("clip_id").orderBy(F.col("m").desc(), "second"))).where("k <= 10")
    worst = worst.groupBy("clip_id").agg(r6(F.avg("m")).alias("worst_mean"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "second"))), lambda x: x["second"].cast("string")), " ").alias("worst"))
    g = s.groupBy("clip_id").agg(p.alias("p"))
    return g.select("clip_id", *(r6(F.col("p")[i]).alias(n) for i, n in enumerate(("p50", "p90", "p99", "top")))).join(worst, "clip_id")


def a24_event_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id")).agg(F.count(F.lit(1)).cast("long").alias("n"), F.count_distinct("event_type").cast("long").alias("kinds"))


def a19_grouped_means(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 5).alias("camera"), "value", (F.col("event_id") % 10 + 1).alias("minutes"))
    g = e.groupingSets([[F.col("event_type")], [F.col("camera")], []], "event_type", "camera").agg(r6(F.sum(F.col("value") * F.col("minutes")) / F.sum("minutes")).alias("mean"))
    return g.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("camera", F.lit(-1)).cast("long").alias("camera"), "mean")


_W = "WINDOW w AS (PARTITION BY clip_id ORDER BY frame)"
_FLAG = f"WITH {SIG}, f AS (SELECT * FROM sig WHERE event_id % 7 < 2)"


def _runs(source: str, gap: int, extra: str = "") -> str:
    return f"""n AS (SELECT *, sum(CASE WHEN frame - p > {gap + 1} THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY frame) AS run FROM (SELECT *, lag(frame) OVER (PARTITION BY clip_id ORDER BY frame) AS p FROM {source})),
        r AS (SELECT clip_id, run::INTEGER AS run, min(frame) AS first, max(frame) AS last, count(*) AS n{extra} FROM n GROUP BY ALL)"""


def _padded(source: str, value: str, half: int) -> str:
    return f"""pad AS (SELECT clip_id, frame, {value} AS v, true AS own FROM {source} UNION ALL SELECT clip_id, min(frame) - k, arg_min({value}, frame), false FROM {source}, range(1, {half + 1}) t(k) GROUP BY clip_id, k
        UNION ALL SELECT clip_id, max(frame) + k, arg_max({value}, frame), false FROM {source}, range(1, {half + 1}) t(k) GROUP BY clip_id, k)"""


_MED = "median({}) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN {} PRECEDING AND {} FOLLOWING)".format
_FILL = """g AS (SELECT clip_id, frame, ix, last_value(CASE WHEN ix IS NOT NULL THEN {'f': frame, 'v': ix} END IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS a,
        first_value(CASE WHEN ix IS NOT NULL THEN {'f': frame, 'v': ix} END IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM duo),
    full_ AS (SELECT clip_id, frame, ix, CASE WHEN ix IS NOT NULL THEN ix WHEN a IS NULL THEN b.v WHEN b IS NULL THEN a.v ELSE a.v + (b.v - a.v) * (frame - a.f) / (b.f - a.f) END AS v FROM g)"""
_SPIKES = f"""WITH {DUO}, px AS (SELECT clip_id, frame, {_MED('x', 2, 2)} AS mx, {_MED('y', 2, 2)} AS my, own FROM (SELECT clip_id, frame, x, y, true AS own FROM duo
        UNION ALL SELECT clip_id, min(frame) - k, arg_min(x, frame), arg_min(y, frame), false FROM duo, range(1, 3) t(k) GROUP BY clip_id, k UNION ALL SELECT clip_id, max(frame) + k, arg_max(x, frame), arg_max(y, frame), false FROM duo, range(1, 3) t(k) GROUP BY clip_id, k)),
    res AS (SELECT d.*, x - mx AS rx, y - my AS ry FROM duo d JOIN px USING (clip_id, frame) WHERE own), len_ AS (SELECT *, sqrt(rx*rx+ry*ry) AS jump FROM res),
    sp AS (SELECT *, jump >= 0.35 AND coalesce(ix, 0) * rx + coalesce(iy, 0) * ry < -0.5 * jump * jump AND rate < 150 AS spike FROM len_),
    nr AS (SELECT *, sum(spike::INTEGER) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) > 0 AND NOT spike AS contaminated FROM sp)"""
_SEC = f"WITH {SIG}, s AS (SELECT clip_id, (frame // 50)::INTEGER AS second, sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS busy, round(avg(x), 6) AS m FROM sig GROUP BY ALL)"

ORACLE = {
    "w02_shifted_sum": f"WITH {SIG} SELECT clip_id, frame, {s6('coalesce(sum(x) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} AS total FROM sig",
    "w03_running_rms": f"WITH {SIG} SELECT clip_id, frame, {s6('sqrt(sum(x*x) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) / 25)')} AS rms FROM sig",
    "w04_running_median": f"WITH {SIG}, {_padded('sig', 'x', 2)} SELECT clip_id, frame, {s6('m')} AS median FROM (SELECT *, {_MED('v', 2, 2)} AS m FROM pad) WHERE own",
    "w05_detail": f"WITH {DUO}, {_FILL}, {_padded('full_', 'v', 25)}, m AS (SELECT *, {_MED('v', 25, 25)} AS m FROM pad) SELECT clip_id, frame, {s6('CASE WHEN ix IS NOT NULL THEN f.v - m END')} AS detail FROM full_ f JOIN m USING (clip_id, frame) WHERE own",
    "w06_dilation": f"WITH {SIG} SELECT clip_id, frame, bool_or(event_id % 53 = 0) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS near FROM sig",
    "w07_hit_count": f"WITH {SIG}, h AS (SELECT clip_id, frame, (sum((event_id % 3 = 0)::INTEGER) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING))::BIGINT AS hits FROM sig) SELECT *, hits >= 3 AS dense FROM h",
    "w08_differences": f"WITH {SIG} SELECT clip_id, frame, {s6('lead(x) OVER w - x')} AS d1, {s6('lead(x) OVER w - 2 * x + lag(x) OVER w')} AS d2 FROM sig {_W}",
    "w09_gap_fill": f"WITH {DUO}, {_FILL} SELECT clip_id, frame, {s6('v')} AS v FROM full_",
    "w10_gradient": f"""WITH {SIG}, t AS (SELECT clip_id, frame, x, us / 1e6::DOUBLE - 1.6e9::DOUBLE AS t FROM sig), n AS (SELECT *, lag(x) OVER w AS y0, lead(x) OVER w AS y1, t - lag(t) OVER w AS a, lead(t) OVER w - t AS b FROM t {_W})
        SELECT clip_id, frame, {s6('CASE WHEN y0 IS NULL THEN (y1 - x) / b WHEN y1 IS NULL THEN (x - y0) / a ELSE (a*a*y1 + (b*b - a*a)*x - b*b*y0) / (a*b*(a+b)) END')} AS slope FROM n""",
    "w11_leaky_release": f"""WITH RECURSIVE {SIG}, y AS (SELECT clip_id, frame, 0.0::DOUBLE AS y FROM sig WHERE frame = 0 UNION ALL SELECT s.clip_id, s.frame, y.y * CASE WHEN s.event_id % 5 = 0 THEN 1.0::DOUBLE ELSE 0.98::DOUBLE END + (s.event_id % 7 - 3) FROM y JOIN sig s ON s.clip_id = y.clip_id AND s.frame = y.frame + 1)
        SELECT clip_id, frame, {s6('y')} AS y FROM y""",
    "w20_windowed_mean": f"WITH {DUO} SELECT clip_id, frame, {s6('avg(ix) OVER w / 5')} AS mean, count(ix) OVER w >= greatest(1, 0.6 * count(*) OVER w) AS reliable FROM duo WINDOW w AS (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
    "w22_excursion": f"WITH {DUO}, c AS (SELECT clip_id, frame, {', '.join(f'{k} - avg({k}) OVER (PARTITION BY clip_id) AS {k}' for k in 'xyz')} FROM duo), s AS (SELECT clip_id, {', '.join(f'sum({k}) OVER w * 0.02::DOUBLE AS {k}' for k in 'xyz')} FROM c {_W}) SELECT clip_id, {s6('max(sqrt(x*x + y*y + z*z))')} AS excursion FROM s GROUP BY clip_id",
    "t04_frame_instants": f"WITH {SIG}, n AS (SELECT clip_id, count(*) AS n FROM sig GROUP BY clip_id) SELECT clip_id, k::INTEGER AS k, round(k * 1e6::DOUBLE / 59.94::DOUBLE, 3) AS t FROM (SELECT clip_id, unnest(range(0, n + 1)) AS k FROM n)",
    "t06_frame_shift": f"WITH {DUO}, {_FILL}, m AS (SELECT clip_id, median(v) AS mid FROM full_ GROUP BY clip_id) SELECT clip_id, frame, 0::DOUBLE AS none, 500::DOUBLE AS constant, {s6('((mid - v) / 2 + 0.5::DOUBLE) * 1000')} AS exposure_var, {s6('(13.58::DOUBLE / 2 - v / 2 + 0.5::DOUBLE) * 1000')} AS exposure FROM full_ JOIN m USING (clip_id)",
    "t08_shifts": f"""WITH {DUO}, {_FILL}, m AS (SELECT clip_id, median(v) AS mid FROM full_ GROUP BY clip_id), s AS (SELECT clip_id, frame, mid, v, ['none', 'constant', 'exposure_var', 'exposure'][length(clip_id) % 4 + 1] AS mode FROM full_ JOIN m USING (clip_id))
        SELECT clip_id, frame, mode, {s6("CASE mode WHEN 'exposure_var' THEN (mid - v) / 2 * 1000 WHEN 'exposure' THEN (13.58::DOUBLE / 2 - v / 2) * 1000 ELSE 0 END")} AS shift FROM s""",
    "i01_islands": f"{_FLAG}, {_runs('f', 2)} SELECT * FROM r",
    "i02_islands_strict": f"{_FLAG}, {_runs('f', 0)} SELECT * FROM r",
    "i04_merge_runs": f"""{_FLAG}, {_runs('f', 0)}, e AS (SELECT *, max(last) OVER (PARTITION BY clip_id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM r), k AS (SELECT *, sum(CASE WHEN first - pe - 1 > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY first) AS k FROM e)
        SELECT clip_id, min(first) AS first, max(last) AS last, count(*) AS parts FROM k GROUP BY clip_id, k""",
    "i05_minimum_length": f"{_FLAG}, {_runs('f', 1, ', bool_or(event_id % 97 = 0) AS marked')} SELECT clip_id, first, last, marked FROM r WHERE last - first + 1 >= 3 OR marked",
    "i06_spikes": f"{_SPIKES} SELECT clip_id, frame, {s6('jump')} AS jump, spike, contaminated FROM nr WHERE spike OR contaminated",
    "flagship_unconfirmed_jumps": f"""{_SPIKES}, f AS (SELECT * FROM sp WHERE spike), {_runs('f', 2, ", max(jump) AS jump, arg_max({'f': frame, 'x': rx, 'y': ry}, {'j': round(jump, 6), 'f': -frame}) AS p")}
        SELECT clip_id, run, first, last, n, {s6('jump')} AS peak, p.f AS peak_frame, CASE WHEN abs(p.x) >= abs(p.y) THEN 'x' ELSE 'y' END AS axis FROM r""",
    "i12_event_find": f"WITH {SIG}, f AS (SELECT * FROM sig WHERE x >= 3), {_runs('f', 5, ", max(x) AS severity, arg_max(frame, {'x': x, 'f': -frame}) AS at_")} SELECT clip_id, run, first, last, {s6('severity')} AS severity, at_ AS at FROM r",
    "i15_usable_window": f"WITH {SIG}, n AS (SELECT *, max(frame) OVER (PARTITION BY clip_id) AS n FROM sig) SELECT clip_id, min(frame) AS a, max(frame) AS b FROM n WHERE event_id % 11 = 0 AND frame >= 50 AND frame <= n - 50 GROUP BY clip_id",
    "i17_even_sample": f"WITH {SIG}, n AS (SELECT clip_id, count(*) AS n FROM sig GROUP BY clip_id), p AS (SELECT DISTINCT clip_id, round_even(k * (n - 1) / 15.0::DOUBLE, 0)::INTEGER AS frame FROM n, range(0, 16) t(k)) SELECT clip_id, frame, event_id FROM sig JOIN p USING (clip_id, frame)",
    "i19_severity_ranking": f"WITH {SIG}, f AS (SELECT * FROM sig WHERE x >= 3), {_runs('f', 5, ', sum(x) AS score')} SELECT clip_id, first, {s6('score')} AS score, (row_number() OVER (PARTITION BY clip_id ORDER BY round(score, 6) DESC, first))::INTEGER AS place FROM r",
    "i20_worst_and_thinned": f"WITH {SIG}, p AS (SELECT clip_id, frame, (row_number() OVER (PARTITION BY clip_id ORDER BY x DESC, frame))::INTEGER AS place FROM sig) SELECT * FROM p WHERE place <= 10 OR frame % 40 = 0",
    "i21_calm_stretch": f"WITH {SIG}, m AS (SELECT clip_id, frame, round(avg(x) OVER v, 6) AS m, count(*) OVER v AS n FROM sig WINDOW v AS (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING)), b AS (SELECT clip_id, min({{'m': m, 'f': frame}}) AS b FROM m WHERE n = 60 AND frame % 10 = 0 GROUP BY clip_id) SELECT clip_id, b.f AS frame, {s6('b.m')} AS mean FROM b",
    "a01_scalar_gain": f"""WITH {DUO}, u AS (SELECT clip_id, CASE WHEN rate BETWEEN 20 AND 150 AND ix IS NOT NULL THEN x END AS a, CASE WHEN rate BETWEEN 20 AND 150 THEN ix END AS b FROM duo)
        SELECT clip_id, {s6('CASE WHEN count(a) >= 200 THEN regr_slope(b, a) ELSE 1 END')} AS gain, {s6('CASE WHEN count(a) >= 200 THEN corr(a, b) END')} AS corr, count(a) AS n FROM u GROUP BY clip_id""",
    "a02_axis_fit": f"""WITH {DUO}, s AS (SELECT clip_id, sum(x*x) AS xx, sum(x*y) AS xy, sum(x*z) AS xz, sum(y*y) AS yy, sum(y*z) AS yz, sum(z*z) AS zz, sum(x*ix) AS tx, sum(y*ix) AS ty, sum(z*ix) AS tz FROM duo WHERE ix IS NOT NULL GROUP BY clip_id),
        d AS (SELECT *, xx*(yy*zz-yz*yz) - xy*(xy*zz-yz*xz) + xz*(xy*yz-yy*xz) AS d FROM s)
        SELECT clip_id, {s6('(tx*(yy*zz-yz*yz) - xy*(ty*zz-yz*tz) + xz*(ty*yz-yy*tz))/d')} AS a, {s6('(xx*(ty*zz-yz*tz) - tx*(xy*zz-yz*xz) + xz*(xy*tz-ty*xz))/d')} AS b, {s6('(xx*(yy*tz-ty*yz) - xy*(xy*tz-ty*xz) + tx*(xy*yz-yy*xz))/d')} AS c FROM d""",
    "a05_mad_scale": f"WITH {SIG} SELECT clip_id, {s6('greatest(0.2, 1.4826::DOUBLE * mad(x))')} AS scale FROM sig GROUP BY clip_id",
    "a06_second_error": f"WITH {DUO} SELECT clip_id, (frame // 50)::INTEGER AS second, {s6('1.4826::DOUBLE * median(abs(ix - x)) FILTER (rate < 200)')} AS error FROM duo GROUP BY ALL HAVING avg(CASE WHEN rate < 200 THEN 1.0::DOUBLE ELSE 0 END) > 0.5",
    "j11_nearest_in_time": f"""{_SEC}, k AS (SELECT a.clip_id, a.second, b.m, row_number() OVER (PARTITION BY a.clip_id, a.second ORDER BY abs(a.second - b.second), b.second) AS k FROM s a JOIN s b ON a.clip_id = b.clip_id AND abs(a.second - b.second) <= 20 WHERE b.busy < 17)
        SELECT clip_id, second, {s6('median(m)')} AS median FROM k WHERE k <= 7 GROUP BY ALL HAVING count(*) >= 5""",
    "a11_jitter_by_band": f"""WITH {DUO}, b AS (SELECT *, CASE WHEN rate < 20 THEN 'calm' WHEN rate < 60 THEN 'middle' ELSE 'fast' END AS band FROM duo), d AS (SELECT clip_id, band, lead(x) OVER w - x AS d, lead(band) OVER w = band AS both_ FROM b {_W})
        SELECT clip_id, band, count(*) AS n, {s6('stddev_pop(d)')} AS jitter FROM d WHERE both_ AND d IS NOT NULL GROUP BY clip_id, band HAVING count(*) > 5""",
    "a12_disagreement": f"""WITH {DUO}, e AS (SELECT clip_id, frame, abs(ix - x) AS e FROM duo WHERE ix IS NOT NULL), t AS (SELECT clip_id, {s6('sqrt(avg(e*e))')} AS rms, {s6('quantile_cont(e, 0.99)')} AS p99, count_if(e >= 1)::BIGINT AS over FROM e GROUP BY clip_id),
        i AS (SELECT clip_id, frame, row_number() OVER (PARTITION BY clip_id ORDER BY frame) - 1 AS i FROM e WHERE e >= 1), f AS (SELECT clip_id, string_agg(frame::VARCHAR, ' ' ORDER BY frame) AS frames FROM i JOIN t USING (clip_id) WHERE i % greatest(over // 40, 1) = 0 GROUP BY clip_id)
        SELECT * FROM t LEFT JOIN f USING (clip_id)""",
    "a17_verdict_rollup": f"{_SEC} SELECT clip_id, count_if(m < 0.45)::BIGINT AS better, count_if(m >= 0.45 AND m < 0.55)::BIGINT AS same, count_if(m >= 0.55)::BIGINT AS worse, {s6('avg(m) FILTER (m < 0.45)')} AS mean_better, {s6('avg(m) FILTER (m >= 0.45 AND m < 0.55)')} AS mean_same, {s6('avg(m) FILTER (m >= 0.55)')} AS mean_worse, {s6('avg(m)')} AS mean, {s6('median(m)')} AS median FROM s GROUP BY clip_id",
    "a18_strength": f"""WITH {SIG}, v AS (SELECT event_id, round(greatest(10.0, least(100.0, 10 + 90 * (1 - exp(-0.65::DOUBLE * (sqrt(greatest(x / 0.5::DOUBLE, 1) * greatest((event_id % 13) / 5.0::DOUBLE, 1)) - 1))))), 6) AS strength FROM sig)
        SELECT *, CASE WHEN strength < 35 THEN 'weak' WHEN strength < 65 THEN 'medium' WHEN strength < 85 THEN 'strong' ELSE 'extreme' END AS level FROM v""",
    "a21_noise_model": f"""WITH {SIG}, s AS (SELECT clip_id, k, sum(x) OVER (PARTITION BY clip_id, k ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS v5, x, frame FROM sig, range(1, 2) t(k)),
        v AS ({' UNION ALL '.join(f"SELECT clip_id, {k} AS k, var_pop(v) AS var FROM (SELECT clip_id, sum(x) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS v FROM sig) GROUP BY clip_id" for k in (1, 2, 3, 4, 5))})
        SELECT clip_id, {s6('regr_slope(var, k)')} AS slope, {s6('regr_intercept(var, k)')} AS noise FROM v GROUP BY clip_id""",
    "a22_rank_correlation": f"""{_SEC}, r AS (SELECT clip_id, m, busy, rank() OVER (PARTITION BY clip_id ORDER BY busy) + (count(*) OVER (PARTITION BY clip_id, busy) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY clip_id ORDER BY m) + (count(*) OVER (PARTITION BY clip_id, m) - 1) / 2.0::DOUBLE AS b FROM s)
        , q AS (SELECT clip_id, quantile_cont(m, 0.9) AS worst, quantile_cont(busy, 0.8) AS top FROM s GROUP BY clip_id)
        SELECT clip_id, {s6('corr(a, b)')} AS spearman, {s6('count_if(m >= worst AND busy >= top) / count_if(m >= worst)::DOUBLE')} AS hit_rate FROM r JOIN q USING (clip_id) GROUP BY clip_id""",
    "a23_percentiles": f"""{_SEC}, k AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY m DESC, second) AS k FROM s), w AS (SELECT clip_id, {s6('avg(m)')} AS worst_mean, string_agg(second::VARCHAR, ' ' ORDER BY k) AS worst FROM k WHERE k <= 10 GROUP BY clip_id),
        p AS (SELECT clip_id, {s6('quantile_cont(m, 0.5)')} AS p50, {s6('quantile_cont(m, 0.9)')} AS p90, {s6('quantile_cont(m, 0.99)')} AS p99, {s6('max(m)')} AS top FROM s GROUP BY clip_id) SELECT * FROM p JOIN w USING (clip_id)""",
    "a24_event_counts": "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id",
    "a19_grouped_means": f"WITH e AS (SELECT event_type, user_id % 5 AS camera, value, event_id % 10 + 1 AS minutes FROM events) SELECT coalesce(event_type, 'all') AS event_type, coalesce(camera, -1)::BIGINT AS camera, {s6('sum(value * minutes) / sum(minutes)')} AS mean FROM e GROUP BY GROUPING SETS ((event_type), (camera), ())",
}

QUERIES = {name: globals()[name] for name in ORACLE}
