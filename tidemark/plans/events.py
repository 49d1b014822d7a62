"""Queries over joins, events, repairs, registries and container tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import gates as G
from ..operators import islands as I
from ..operators import windows as W
from .series import _SEC, K, _flagged, _runs, _seconds, _w
from .views import DUO, SIG, duo, r6, s6, sig, table


#: Line numbers repeat within an order: with these the order of its lines is whole.
_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def _spans(spark, sf_dir) -> DataFrame:
    """Spans of each series: runs of busy rows at least three long, with a margin of two."""
    runs = I.longer(I.islands(_flagged(spark, sf_dir), K, "frame", 1), 3)
    return runs.select("clip_id", "run", (F.col("first") - 2).alias("a"), (F.col("last") + 2).alias("b"))


_SPAN = f"{{}}, f AS (SELECT * FROM sig WHERE event_id % 7 < 2), {_runs('f', 1)}, spans AS (SELECT clip_id, run, first - 2 AS a, last + 2 AS b FROM r WHERE last - first + 1 >= 3)"
_SPANS, _DSPANS = _SPAN.format(f"WITH {SIG}"), _SPAN.format(f"WITH {DUO}")


def j03_edits(spark, sf_dir):
    s = sig(spark, sf_dir)
    edit = s.where("event_id % 13 = 0").select("clip_id", "frame", (-F.col("x")).alias("edit"))
    return s.join(edit, ["clip_id", "frame"], "left").select("clip_id", "frame", r6(F.coalesce("edit", "x")).alias("x"), F.col("edit").isNotNull().alias("edited"))


def j04_fuzzy_key(spark, sf_dir):
    s = sig(spark, sf_dir)
    known = s.where("event_id % 4 = 0").select("clip_id", F.col("frame").alias("key"), F.col("event_id").alias("found"))
    tries = s.select("clip_id", "frame", F.posexplode(F.array(F.col("frame"), F.col("frame") + 1, F.col("frame") - 1)).alias("turn", "key"))
    return tries.join(known, ["clip_id", "key"]).groupBy("clip_id", "frame").agg(F.min_by("found", "turn").alias("found"))


def j05_shorter_wins(spark, sf_dir):
    """The k-th frame of one sensor against the k-th seen one of the other, which are fewer."""
    d = duo(spark, sf_dir)
    img = d.where("ix is not null").select("clip_id", (F.row_number().over(_w()) - 1).alias("frame"), "ix")
    return d.select("clip_id", "frame", "x").join(img, ["clip_id", "frame"]).select("clip_id", "frame", r6(F.col("ix") - F.col("x")).alias("delta"))


def j06_same_grid(spark, sf_dir):
    s = sig(spark, sf_dir)
    a, b = s.where("event_id % 101 <> 0").select("clip_id", "frame", F.col("x").alias("a")), s.where("event_id % 103 <> 0").select("clip_id", "frame", F.col("x").alias("b"))
    met = a.join(b, ["clip_id", "frame"], "full")
    return met.groupBy("clip_id").agg(F.count_if(F.col("a").isNull()).alias("only_b"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.abs(F.col("a") - F.col("b")) > 1e-9).alias("differ"))


def j08_membership(spark, sf_dir):
    met = G.within(sig(spark, sf_dir).select("clip_id", "frame", "x"), _spans(spark, sf_dir), K, "frame", "a", "b", 64)
    return met.groupBy("clip_id", "run").agg(F.count(F.lit(1)).alias("n"), r6(F.max("x")).alias("peak"))


def j09_edge_semi(spark, sf_dir):
    s = _spans(spark, sf_dir)
    edges = s.select("clip_id", "run", F.explode(F.array("a", "b")).alias("at"))
    wide = I.islands(sig(spark, sf_dir).where("x >= 3"), K, "frame", 5).select(F.col("clip_id"), F.col("first"), F.col("last"))
    return G.within(edges, wide, K, "at", "first", "last", 64).select("clip_id", "run").distinct()


def j10_outside(spark, sf_dir):
    inside = G.within(sig(spark, sf_dir).select("clip_id", "frame"), _spans(spark, sf_dir), K, "frame", "a", "b", 64).select("clip_id", "frame").distinct()
    return sig(spark, sf_dir).join(inside, ["clip_id", "frame"], "left_anti").groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("x")).alias("mean"))


def j12_set_difference(spark, sf_dir):
    a = I.islands(_flagged(spark, sf_dir), K, "frame", 1).select("clip_id", "first", "last")
    b = I.islands(_flagged(spark, sf_dir), K, "frame", 2).select("clip_id", "first", "last")
    return a.exceptAll(b).withColumn("kind", F.lit("gone")).union(b.exceptAll(a).withColumn("kind", F.lit("new")))


def j13_overlaps(spark, sf_dir):
    met = G.within(sig(spark, sf_dir).select("clip_id", "frame"), _spans(spark, sf_dir), K, "frame", "a", "b", 64)
    gain = F.round(G.cosine_gate(F.col("frame").cast("double"), F.col("a") - 1.0, F.col("b") + 1.0, 3.0), 6)
    best = G.strongest(met.withColumn("gain", gain), ["clip_id", "frame"], "gain", "run", ["run", "gain"])
    return best.select("clip_id", "frame", "run", r6(F.col("gain")).alias("gain"))


def w16_cosine_gate(spark, sf_dir):
    s = sig(spark, sf_dir).select("clip_id", "frame")
    met = G.within(s, _spans(spark, sf_dir), K, "frame", "a", "b", 64)
    gate = met.groupBy("clip_id", "frame").agg(F.max(G.cosine_gate(F.col("frame").cast("double"), F.col("a").cast("double"), F.col("b").cast("double"), 2.0)).alias("g"))
    return s.join(gate, ["clip_id", "frame"], "left").select("clip_id", "frame", r6(F.coalesce("g", F.lit(0.0))).alias("gate"))


def _in_spans(spark, sf_dir) -> DataFrame:
    d = duo(spark, sf_dir).select("clip_id", "frame", (F.coalesce("ix", F.lit(0.0)) - F.col("x")).alias("v"))
    return G.within(d, _spans(spark, sf_dir), K, "frame", "a", "b", 64)


def w17_taper(spark, sf_dir):
    m = _in_spans(spark, sf_dir)
    t = G.taper((F.col("frame") - F.col("a")).cast("double"), (F.col("b") - F.col("a") + 1).cast("double"), 3)
    return m.select("clip_id", "run", "frame", r6(F.col("v") * t).alias("v"))


def w18_zero_net(spark, sf_dir):
    return _in_spans(spark, sf_dir).select("clip_id", "run", "frame", F.round(G.zero_net("v", ["clip_id", "run"]), 10).alias("v"))


def w19_deramp(spark, sf_dir):
    """Tapered by a Hann window, summed up, and less the straight line from its first sum to its last."""
    return G.deramped(_in_spans(spark, sf_dir), "v", ["clip_id", "run"], "frame").select("clip_id", "run", "frame", F.round("v", 10).alias("v"))


def w25_bridge(spark, sf_dir):
    """Inside each span a straight line between the mean of the ten frames before and the ten after."""
    spans = _spans(spark, sf_dir)
    s = sig(spark, sf_dir).select("clip_id", "frame", "x")
    around = spans.select("clip_id", "run", "a", "b", (F.col("a") - 10).alias("lo"), (F.col("b") + 10).alias("hi"))
    met = G.within(s, around, K, "frame", "lo", "hi", 64)
    ends = met.groupBy("clip_id", "run").agg(F.avg(F.when(F.col("frame") < F.col("a"), F.col("x"))).alias("before"), F.avg(F.when(F.col("frame") > F.col("b"), F.col("x"))).alias("after"))
    inside = met.where("frame between a and b").join(ends, ["clip_id", "run"]).where("before is not null and after is not null")
    k = (F.col("frame") - F.col("a") + 1) / (F.col("b") - F.col("a") + 2)
    return inside.select("clip_id", "run", "frame", F.round(F.col("before") + (F.col("after") - F.col("before")) * k, 10).alias("x"))


def a14_event_check(spark, sf_dir):
    d = duo(spark, sf_dir).where("ix is not null").select("clip_id", "frame", F.explode(F.array(F.struct(F.col("x").alias("p"), F.col("ix").alias("q")), F.struct(F.col("y").alias("p"), F.col("iy").alias("q")))).alias("v"))
    m = G.within(d, _spans(spark, sf_dir), K, "frame", "a", "b", 64)
    p, q = F.col("v.p"), F.col("v.q")
    g = m.groupBy("clip_id", "run").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr(p, q), 6).alias("corr"), (F.sum(p * q) / F.sum(p * p)).alias("gain")).where("n >= 6")
    verdict = F.when(F.col("corr") > 0.5, "confirmed").when(F.col("corr") < -0.3, "opposed").otherwise("unclear")
    return g.select("clip_id", "run", "n", "corr", r6(F.col("gain")).alias("gain"), verdict.alias("verdict"))


def a13_axis_map(spark, sf_dir):
    """The signed order of axes that maps one sensor onto the other with the least mean distance; ties: the first."""
    import itertools

    maps = [(k, *p, *s) for k, (p, s) in enumerate(itertools.product(itertools.permutations(range(3)), itertools.product((1, -1), repeat=3)))]
    m = spark.createDataFrame(maps, "k int, p0 int, p1 int, p2 int, s0 int, s1 int, s2 int")  # the 48 maps
    d = duo(spark, sf_dir).where("ix is not null").select("clip_id", F.array("ix", "iy", "iz").alias("i"), F.array("x", "y", "z").alias("t"))
    met = d.join(F.broadcast(m))
    gap = reduce(lambda a, b: a + b, (F.pow(F.col("i")[F.col(f"p{j}")] * F.col(f"s{j}") - F.col("t")[j], F.lit(2.0)) for j in range(3)))
    err = met.groupBy("clip_id", "k").agg(F.round(F.avg(F.sqrt(gap)), 6).alias("err"))
    best = err.groupBy("clip_id").agg(F.min(F.struct("err", "k")).alias("b"))
    return best.select("clip_id", "b.k", r6(F.col("b.err")).alias("err"))


def a16_improvement(spark, sf_dir):
    s = _seconds(spark, sf_dir)
    gain = F.try_divide(100 * (F.col("busy") - F.col("m") * 7), F.nullif(F.col("busy").cast("double"), F.lit(0.0)))
    d = s.select("clip_id", "second", F.round(gain, 6).alias("gain"))
    return d.withColumn("verdict", F.when(F.col("gain") >= 15, "improved").when(F.col("gain") < -10, "worsened").otherwise("same"))


def i08_weights(spark, sf_dir):
    v = a14_event_check(spark, sf_dir).select("clip_id", "run", F.when(F.col("verdict") == "confirmed", 1.0).when(F.col("verdict") == "opposed", 0.0).otherwise(0.5).alias("w"))
    spans = _spans(spark, sf_dir).join(v, ["clip_id", "run"], "left").withColumn("w", F.coalesce("w", F.lit(0.5)))
    met = G.within(sig(spark, sf_dir).select("clip_id", "frame"), spans, K, "frame", "a", "b", 64)
    return met.groupBy("clip_id", "frame").agg(r6(F.sum("w")).alias("weight"))


def i22_chains(spark, sf_dir):
    """Parts of an order that follow one another in number and within 30 days, where more than one do."""
    w = Window.partitionBy("l_orderkey").orderBy(*_LINE)
    d = F.to_date("l_shipdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *_LINE, d.alias("d"))
    new = F.when((F.col("l_linenumber") - F.lag("l_linenumber").over(w) == 1) & (F.abs(F.datediff("d", F.lag("d").over(w))) <= 30), 0).otherwise(1)
    c = li.withColumn("_n", new).withColumn("chain", F.sum("_n").over(w))
    return c.groupBy("l_orderkey", "chain").agg(F.min("l_linenumber").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("l_orderkey", "first", "n")


def i23_keep_old(spark, sf_dir):
    s = sig(spark, sf_dir)
    fresh = s.where("event_id % 5 = 0").groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.lit("new").alias("kind")).where("n % 2 = 0")
    old = s.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.lit("old").alias("kind"))
    return old.join(fresh, "clip_id", "left_anti").unionByName(fresh)


def i24_checks(spark, sf_dir):
    """What is wrong with a list of events: keys that stand twice, values out of range, spans beyond their series, series
    with too few spans."""
    e = table(spark, sf_dir, "events")
    twice = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("twice").alias("kind"), F.concat_ws(" ", F.col("user_id").cast("string"), F.date_format("day", "yyyy-MM-dd")).alias("key"), "n")
    out = e.where("not (value between 20 and 400)").select(F.lit("range"), F.col("event_id").cast("string"), F.lit(1).cast("long"))
    spans = _spans(spark, sf_dir)
    window = sig(spark, sf_dir).groupBy("clip_id").agg((F.min("frame") + 20).alias("lo"), (F.max("frame") - 20).alias("hi"))
    beyond = spans.join(window, "clip_id").where("a < lo or b > hi").select(F.lit("beyond"), F.concat_ws(" ", "clip_id", F.col("run").cast("string")), F.lit(1).cast("long"))
    few = window.join(spans.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n")), "clip_id", "left").select(F.lit("count"), "clip_id", F.coalesce("n", F.lit(0)).alias("n")).where("n < 200")
    return twice.union(out).union(beyond).union(few)


def i27_slices(spark, sf_dir):
    return sig(spark, sf_dir).where("frame >= 100 and frame < 150").select("clip_id", "frame", r6(F.col("x")).alias("x"))


def s04_sample_offsets(spark, sf_dir):
    """Offsets of samples within their chunk: the sizes before them."""
    w = ["l_orderkey"]
    li = table(spark, sf_dir, "lineitem").withColumn("size", F.col("l_quantity").cast("long"))
    off = F.coalesce(F.sum("size").over(Window.partitionBy(*w).orderBy(*_LINE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return li.select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 1000 + off).alias("offset"), "size")


def s05_sample_times(spark, sf_dir):
    """Run-length pairs of count and step to the time of each sample."""
    r = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").alias("count"), (F.col("p_partkey") % 7 + 1).alias("step"))
    each = r.select("p_brand", "p_partkey", "step", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("k"))
    t = F.coalesce(F.sum("step").over(Window.partitionBy("p_brand").orderBy("p_partkey", "k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.select("p_brand", "p_partkey", "k", t.alias("t"))


def s12_exposure(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("num"), (F.col("event_id") % 50).alias("den"))
    s = F.try_divide(F.col("num").cast("double"), F.nullif("den", F.lit(0)).cast("double"))
    return e.select("event_id", r6(s).alias("exposure_s"), r6(s * 1000).alias("exposure_ms"))


def s19_unique_name(spark, sf_dir):
    """Of each brand the part whose name holds the brand's text; an error where none or more than one does."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", F.lower("p_brand"), "p_name").alias("name"), F.lower("p_brand").alias("key"), (F.col("p_partkey") % 997).cast("string").alias("tag"))
    asked = p.groupBy("key").agg(F.max("tag").alias("tag"))
    hit = p.drop("tag").join(asked, "key").groupBy("key").agg(F.count_if(F.col("p_partkey").cast("string").contains(F.col("tag"))).alias("n"), F.min(F.when(F.col("p_partkey").cast("string").contains(F.col("tag")), F.col("name"))).alias("found"))
    problem = F.when(F.col("n") == 0, "none matches").when(F.col("n") > 1, "several match")
    return hit.select("key", F.when(F.col("n") == 1, F.col("found")).alias("name"), "n", problem.alias("problem"))


def s20_registry(spark, sf_dir):
    """Pages not known yet that are long enough, open as pages do and are no queries, with a short name from their
    address, made unique by a number."""
    p = table(spark, sf_dir, "pages").where(F.length("html") >= 1500).where(F.lower(F.substring(F.ltrim("html"), 1, 1)) == "<").select("page_id", "url").where(~F.col("url").contains("?"))
    known = p.where("page_id % 3 = 0").select("url").distinct()
    slug = F.regexp_replace(F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)), "[^a-z0-9]+", "_")
    new = p.join(known, "url", "left_anti").withColumn("slug", slug)
    k = F.row_number().over(Window.partitionBy("slug").orderBy("page_id"))
    return new.select("page_id", F.concat("slug", F.when(k > 1, F.concat(F.lit("_"), k.cast("string"))).otherwise("")).alias("name"))


def q21_time_parse(spark, sf_dir):
    """'H:MM:SS,f', 'MM:SS' or seconds as milliseconds; minutes and seconds of 60 or more give none."""
    v = F.col("event_id")
    text = F.when(v % 3 == 0, F.concat((v % 100).cast("string"), F.lit(",5"))).when(v % 3 == 1, F.concat((v % 70).cast("string"), F.lit(":"), F.lpad((v % 61).cast("string"), 2, "0"))).otherwise(F.concat((v % 5).cast("string"), F.lit(":"), F.lpad((v % 60).cast("string"), 2, "0"), F.lit(":07.25")))
    d = table(spark, sf_dir, "events").select("event_id", text.alias("s"))
    part = F.transform(F.split(F.translate("s", ",", "."), ":"), lambda x: (x.cast("decimal(12,3)") * 1000).cast("long"))
    d = d.withColumn("p", part).withColumn("n", F.size("p"))
    at = lambda k: F.try_element_at("p", F.lit(-k))
    bad = ((F.col("n") > 1) & (at(1) >= 60000)) | ((F.col("n") > 2) & (at(2) >= 60000))
    ms = at(1) + F.coalesce(at(2), F.lit(0)) * 60 + F.coalesce(at(3), F.lit(0)) * 3600
    return d.select("event_id", F.when(~bad, ms).alias("ms"))


def t01_timeline(spark, sf_dir):
    """Sample times from frame stamps, the number of samples of a frame, and rates."""
    s = sig(spark, sf_dir).withColumn("stamp", F.when(F.col("event_id") % 17 != 0, F.col("us")))
    first = F.first("stamp", ignorenulls=True).over(_w().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    n = (F.col("event_id") % 5 + 1).cast("int")
    d = s.withColumn("first", first).where("stamp is not null").withColumn("n", n)
    d = d.select("clip_id", "frame", "n", ((F.col("stamp") - F.col("first")) / 1000).alias("ms"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return d.select("clip_id", "frame", "i", F.round((F.col("ms") + F.col("i") / F.col("n") * 1000 / 59.5) / (59.94 / 59.5) * 1000, 0).alias("t_us"))


def t03_dedupe(spark, sf_dir):
    s = sig(spark, sf_dir).withColumn("t", F.floor(F.col("us") / 3600000000))
    w = Window.partitionBy("clip_id", "t").orderBy("frame")
    return s.withColumn("k", F.row_number().over(w)).where("k = 1").select("clip_id", "t", "frame")


_IN = "FROM sig s JOIN spans p ON s.clip_id = p.clip_id AND s.frame BETWEEN p.a AND p.b"
_INV = f"{_DSPANS}, m AS (SELECT d.clip_id, p.run, d.frame, p.a, p.b, coalesce(ix, 0) - x AS v FROM duo d JOIN spans p ON d.clip_id = p.clip_id AND d.frame BETWEEN p.a AND p.b)"
_GATE = "CASE WHEN least(1, least(s.frame - {a}, {b} - s.frame) / {f}) > 0 THEN 0.5 - 0.5 * cos(pi() * least(1, least(s.frame - {a}, {b} - s.frame) / {f})) ELSE 0 END".format
_CHECK = f"""{_DSPANS}, v AS (SELECT clip_id, frame, x AS p, ix AS q FROM duo WHERE ix IS NOT NULL UNION ALL SELECT clip_id, frame, y, iy FROM duo WHERE ix IS NOT NULL),
    g AS (SELECT s.clip_id, s.run, count(*) AS n, round(corr(p, q), 6) AS corr, sum(p * q) / sum(p * p) AS gain FROM v JOIN spans s ON v.clip_id = s.clip_id AND v.frame BETWEEN s.a AND s.b GROUP BY ALL HAVING count(*) >= 6),
    checked AS (SELECT clip_id, run, n, corr, {s6('gain')} AS gain, CASE WHEN corr > 0.5 THEN 'confirmed' WHEN corr < -0.3 THEN 'opposed' ELSE 'unclear' END AS verdict FROM g)"""

ORACLE = {
    "j03_edits": f"WITH {SIG} SELECT clip_id, frame, {s6('CASE WHEN event_id % 13 = 0 THEN -x ELSE x END')} AS x, event_id % 13 = 0 AS edited FROM sig",
    "j04_fuzzy_key": f"WITH {SIG}, k AS (SELECT clip_id, frame AS key, event_id AS found FROM sig WHERE event_id % 4 = 0) SELECT s.clip_id, s.frame, arg_min(found, turn) AS found FROM sig s, (VALUES (0, 0), (1, 1), (2, -1)) o(turn, d), k WHERE k.clip_id = s.clip_id AND k.key = s.frame + d GROUP BY ALL",
    "j05_shorter_wins": f"WITH {DUO}, i AS (SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY frame) - 1 AS frame, ix AS v FROM duo WHERE ix IS NOT NULL) SELECT d.clip_id, d.frame, {s6('v - x')} AS delta FROM duo d JOIN i USING (clip_id, frame)",
    "j06_same_grid": f"WITH {SIG} SELECT clip_id, count_if(event_id % 101 = 0 AND event_id % 103 <> 0)::BIGINT AS only_b, count_if(event_id % 103 = 0 AND event_id % 101 <> 0)::BIGINT AS only_a, 0::BIGINT AS differ FROM sig GROUP BY clip_id",
    "j08_membership": f"{_SPANS} SELECT s.clip_id, p.run, count(*) AS n, {s6('max(x)')} AS peak {_IN} GROUP BY ALL",
    "j09_edge_semi": f"""{_SPANS}, w0 AS (SELECT *, lag(frame) OVER (PARTITION BY clip_id ORDER BY frame) AS p FROM sig WHERE x >= 3), w1 AS (SELECT *, sum(CASE WHEN frame - p > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY frame) AS k FROM w0), w2 AS (SELECT clip_id, k, min(frame) AS lo, max(frame) AS hi FROM w1 GROUP BY ALL)
        SELECT clip_id, run FROM spans s WHERE EXISTS (SELECT 1 FROM w2 WHERE w2.clip_id = s.clip_id AND (s.a BETWEEN lo AND hi OR s.b BETWEEN lo AND hi))""",
    "j10_outside": f"{_SPANS} SELECT clip_id, count(*) AS n, {s6('avg(x)')} AS mean FROM sig s WHERE NOT EXISTS (SELECT 1 FROM spans p WHERE p.clip_id = s.clip_id AND s.frame BETWEEN p.a AND p.b) GROUP BY clip_id",
    "j12_set_difference": f"""WITH {SIG}, f AS (SELECT * FROM sig WHERE event_id % 7 < 2), {_runs('f', 1)}, {_runs('f', 2).replace('n AS (', 'n2 AS (').replace('r AS (', 'r2 AS (').replace('FROM n GROUP', 'FROM n2 GROUP')}
        SELECT *, 'gone' AS kind FROM (SELECT clip_id, first, last FROM r EXCEPT ALL SELECT clip_id, first, last FROM r2) UNION ALL SELECT *, 'new' FROM (SELECT clip_id, first, last FROM r2 EXCEPT ALL SELECT clip_id, first, last FROM r)""",
    "j13_overlaps": f"{_SPANS}, m AS (SELECT s.clip_id, s.frame, p.run, round({_GATE(a='(p.a - 1)', b='(p.b + 1)', f='3.0::DOUBLE')}, 6) AS gain {_IN}), k AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame ORDER BY gain DESC, run) AS k FROM m) SELECT clip_id, frame, run, {s6('gain')} AS gain FROM k WHERE k = 1",
    "w16_cosine_gate": f"{_SPANS} SELECT s.clip_id, s.frame, {s6('coalesce(max(CASE WHEN p.a IS NULL THEN 0 ELSE ' + _GATE(a='p.a', b='p.b', f='2.0::DOUBLE') + ' END), 0)')} AS gate {_IN.replace('JOIN', 'LEFT JOIN')} GROUP BY ALL",
    "w17_taper": f"{_INV} SELECT clip_id, run, frame, {s6('v * CASE WHEN least(frame - a + 1, b - frame + 1) > 3 THEN 1 ELSE 0.5 - 0.5 * cos(pi() * least(frame - a + 1, b - frame + 1) / 4) END')} AS v FROM m",
    "w18_zero_net": f"{_INV} SELECT clip_id, run, frame, round(v - avg(v) OVER (PARTITION BY clip_id, run), 10) AS v FROM m",
    "w19_deramp": f"""{_INV}, h AS (SELECT clip_id, run, frame, v, row_number() OVER (PARTITION BY clip_id, run ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY clip_id, run) - 1 AS n FROM m),
        t AS (SELECT clip_id, run, frame, i, n, sum(v * CASE WHEN n > 0 THEN 0.5 - 0.5 * cos(2 * pi() * i / n) ELSE 1 END) OVER (PARTITION BY clip_id, run ORDER BY frame) AS s FROM h)
        SELECT clip_id, run, frame, round(s - CASE WHEN n > 0 THEN last_value(s) OVER (PARTITION BY clip_id, run ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * i / n ELSE 0 END, 10) AS v FROM t""",
    "w25_bridge": f"""{_SPANS}, m AS (SELECT s.clip_id, p.run, s.frame, p.a, p.b, s.x FROM sig s JOIN spans p ON s.clip_id = p.clip_id AND s.frame BETWEEN p.a - 10 AND p.b + 10), e AS (SELECT clip_id, run, avg(x) FILTER (frame < a) AS before, avg(x) FILTER (frame > b) AS after FROM m GROUP BY ALL)
        SELECT clip_id, run, frame, round(before + (after - before) * ((frame - a + 1) / (b - a + 2)::DOUBLE), 10) AS x FROM m JOIN e USING (clip_id, run) WHERE frame BETWEEN a AND b AND before IS NOT NULL AND after IS NOT NULL""",
    "a14_event_check": f"{_CHECK} SELECT * FROM checked",
    "a13_axis_map": f"""WITH {DUO}, mp AS (SELECT (row_number() OVER (ORDER BY p0, p1, s0 DESC, s1 DESC, s2 DESC) - 1)::INTEGER AS k, * FROM (SELECT * FROM (VALUES (1, 2, 3), (1, 3, 2), (2, 1, 3), (2, 3, 1), (3, 1, 2), (3, 2, 1)) p(p0, p1, p2), (VALUES (1), (-1)) a(s0), (VALUES (1), (-1)) b(s1), (VALUES (1), (-1)) c(s2))),
        e AS (SELECT clip_id, k, round(avg(sqrt(([ix, iy, iz][p0] * s0 - x) ** 2 + ([ix, iy, iz][p1] * s1 - y) ** 2 + ([ix, iy, iz][p2] * s2 - z) ** 2)), 6) AS err FROM duo, mp WHERE ix IS NOT NULL GROUP BY ALL)
        SELECT clip_id, b.k AS k, {s6('b.e')} AS err FROM (SELECT clip_id, min({{'e': err, 'k': k}}) AS b FROM e GROUP BY clip_id)""",
    "a16_improvement": f"{_SEC}, g AS (SELECT clip_id, second, round(100 * (busy - m * 7) / nullif(busy::DOUBLE, 0), 6) AS gain FROM s) SELECT *, CASE WHEN gain >= 15 THEN 'improved' WHEN gain < -10 THEN 'worsened' ELSE 'same' END AS verdict FROM g",
    "i08_weights": f"{_CHECK}, w AS (SELECT p.*, coalesce(CASE verdict WHEN 'confirmed' THEN 1.0::DOUBLE WHEN 'opposed' THEN 0.0 WHEN 'unclear' THEN 0.5 END, 0.5) AS w FROM spans p LEFT JOIN checked USING (clip_id, run)) SELECT s.clip_id, s.frame, {s6('sum(w)')} AS weight FROM sig s JOIN w ON s.clip_id = w.clip_id AND s.frame BETWEEN w.a AND w.b GROUP BY ALL",
    "i22_chains": """WITH l AS (SELECT *, l_shipdate::DATE AS d FROM lineitem), n AS (SELECT *, CASE WHEN l_linenumber - lag(l_linenumber) OVER w = 1 AND abs(d - lag(d) OVER w) <= 30 THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)),
        c AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS chain FROM n) SELECT l_orderkey, min(l_linenumber) AS first, count(*) AS n FROM c GROUP BY l_orderkey, chain HAVING count(*) > 1""",
    "i23_keep_old": f"WITH {SIG}, fresh AS (SELECT clip_id, count(*) AS n, 'new' AS kind FROM sig WHERE event_id % 5 = 0 GROUP BY clip_id HAVING count(*) % 2 = 0) SELECT * FROM fresh UNION ALL SELECT clip_id, count(*), 'old' FROM sig WHERE clip_id NOT IN (SELECT clip_id FROM fresh) GROUP BY clip_id",
    "i24_checks": f"""{_SPANS}, w AS (SELECT clip_id, min(frame) + 20 AS lo, max(frame) - 20 AS hi FROM sig GROUP BY clip_id)
        SELECT 'twice' AS kind, user_id || ' ' || strftime(ts::DATE, '%Y-%m-%d') AS key, count(*) AS n FROM events GROUP BY user_id, ts::DATE HAVING count(*) > 1 UNION ALL SELECT 'range', event_id::VARCHAR, 1 FROM events WHERE NOT value BETWEEN 20 AND 400
        UNION ALL SELECT 'beyond', clip_id || ' ' || run::INTEGER, 1 FROM spans JOIN w USING (clip_id) WHERE a < lo OR b > hi UNION ALL SELECT 'count', clip_id, count(run) AS n FROM w LEFT JOIN spans USING (clip_id) GROUP BY clip_id HAVING count(run) < 200""",
    "i27_slices": f"WITH {SIG} SELECT clip_id, frame, {s6('x')} AS x FROM sig WHERE frame >= 100 AND frame < 150",
    "s04_sample_offsets": "SELECT l_orderkey, l_linenumber, (l_orderkey * 1000 + coalesce(sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS \"offset\", l_quantity::BIGINT AS size FROM lineitem",
    "s05_sample_times": "WITH e AS (SELECT p_brand, p_partkey, p_partkey % 7 + 1 AS step, unnest(range(1, p_size + 1))::INTEGER AS k FROM part) SELECT p_brand, p_partkey, k, coalesce(sum(step) OVER (PARTITION BY p_brand ORDER BY p_partkey, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS t FROM e",
    "s12_exposure": f"WITH e AS (SELECT event_id, user_id::DOUBLE / nullif(event_id % 50, 0) AS s FROM events) SELECT event_id, {s6('s')} AS exposure_s, {s6('s * 1000')} AS exposure_ms FROM e",
    "s19_unique_name": """WITH p AS (SELECT p_partkey, lower(p_brand) || ' ' || p_name AS name, lower(p_brand) AS key, (p_partkey % 997)::VARCHAR AS tag FROM part), a AS (SELECT key, max(tag) AS tag FROM p GROUP BY key),
        h AS (SELECT key, count_if(contains(p_partkey::VARCHAR, a.tag))::BIGINT AS n, min(name) FILTER (contains(p_partkey::VARCHAR, a.tag)) AS found FROM p JOIN a USING (key) GROUP BY key)
        SELECT key, CASE WHEN n = 1 THEN found END AS name, n, CASE WHEN n = 0 THEN 'none matches' WHEN n > 1 THEN 'several match' END AS problem FROM h""",
    "s20_registry": r"WITH ok AS (SELECT page_id, url FROM pages WHERE length(html) >= 1500 AND substr(ltrim(html, ' '), 1, 1) = '<' AND NOT contains(url, '?')), n AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '[^a-z0-9]+', '_', 'g') AS slug FROM ok WHERE url NOT IN (SELECT url FROM ok WHERE page_id % 3 = 0)), k AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY page_id) AS k FROM n) SELECT page_id, slug || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS name FROM k",
    "q21_time_parse": """SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id % 100 * 1000 + 500 WHEN 1 THEN CASE WHEN event_id % 61 < 60 THEN event_id % 70 * 60000 + event_id % 61 * 1000 END ELSE event_id % 5 * 3600000 + event_id % 60 * 60000 + 7250 END AS ms FROM events""",
    "t01_timeline": f"""WITH {SIG}, s AS (SELECT *, CASE WHEN event_id % 17 <> 0 THEN us END AS stamp, (event_id % 5 + 1)::INTEGER AS n FROM sig), f AS (SELECT *, first_value(stamp IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f0 FROM s),
        e AS (SELECT clip_id, frame, n, (stamp - f0) / 1000::DOUBLE AS ms, unnest(range(0, n))::INTEGER AS i FROM f WHERE stamp IS NOT NULL) SELECT clip_id, frame, i, round((ms + i / n::DOUBLE * 1000 / 59.5::DOUBLE) / (59.94::DOUBLE / 59.5::DOUBLE) * 1000, 0) AS t_us FROM e""",
    "t03_dedupe": f"WITH {SIG} SELECT clip_id, us // 3600000000 AS t, min(frame) AS frame FROM sig GROUP BY ALL",
}

QUERIES = {name: globals()[name] for name in ORACLE}
