import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import quaternion as Q
from tidemark.operators import asof, filters, gates, islands, spikes, stats
from tidemark.operators import windows as W
from tidemark.plans import filtering

K = ["c"]


def series(spark, values, name="x"):
    return spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], f"c string, frame int, {name} double")


def values(df, name):
    return [r[name] for r in df.orderBy("frame").collect()]


def test_framed_windows_do_not_depend_on_chunks(spark):
    df = series(spark, [float((i * 37) % 11) for i in range(100)])
    for before, after in ((2, 2), (5, 0), (0, 7)):
        sums = lambda rows, _: F.sum("x").over(rows)
        whole = values(W.framed(df, K, "frame", before, after, {"s": sums}), "s")
        assert values(W.framed(df, K, "frame", before, after, {"s": sums}, chunk=10), "s") == whole


def test_running_median_repeats_the_ends(spark):
    x = np.array([5.0, 1.0, 4.0, 2.0, 8.0, 0.0, 3.0])
    padded = np.concatenate([[x[0]] * 2, x, [x[-1]] * 2])
    expected = [float(np.median(padded[i : i + 5])) for i in range(len(x))]
    assert values(W.running_median(series(spark, x.tolist()), K, "frame", "x", 5, "m", chunk=4), "m") == expected


def test_leaky_release_of_a_long_series(spark):
    n, keep = 30_000, 0.98
    step, held = [float(i % 7 - 3) for i in range(n)], [i % 5 == 0 for i in range(n)]
    df = spark.createDataFrame([("a", i, step[i] if i else 0.0, held[i]) for i in range(n)], "c string, frame int, step double, held boolean")
    y, expected = 0.0, []
    for i in range(n):
        y = y * (1 if held[i] else keep) + (step[i] if i else 0.0)
        expected.append(y)
    assert values(W.leaky_release(df, K, "frame", "step", "held", keep, "y"), "y") == pytest.approx(expected, abs=1e-9)


def test_shifted_sum(spark):
    df = series(spark, [1.0, 2.0, 3.0])
    assert values(df.withColumn("s", W.cumulative_before(F.col("x"), K, "frame")), "s") == [0.0, 1.0, 3.0]


@pytest.mark.parametrize("gap", [0, 1, 2])
def test_islands_and_their_gap(spark, gap):
    flags = [0, 1, 4, 5, 9, 11, 12, 13]
    runs, last = [], None
    for f in flags:
        if last is None or f - last > gap + 1:
            runs.append([f, f])
        runs[-1][1] = last = f
    found = islands.islands(spark.createDataFrame([("a", f) for f in flags], "c string, frame int"), K, "frame", gap)
    assert sorted((r["first"], r["last"]) for r in found.collect()) == [tuple(r) for r in runs]


def test_only_the_unconfirmed_jump_is_a_spike(spark):
    y = [0.3] * 200
    y[100] = y[150] = 1.8
    image = [0.3] * 200
    image[150] = 1.8
    df = spark.createDataFrame([("a", i, 0.0, y[i], 0.0, image[i], 10.0) for i in range(200)], "c string, frame int, x double, y double, ix double, iy double, rate double")
    # the witness is what the image saw beyond its own calm value
    df = df.withColumn("iy", F.col("iy") - 0.3 - F.when(F.col("frame") == 100, 1.5).otherwise(0.0))
    found = {r.frame: r for r in spikes.unconfirmed(df, K, "frame", ["x", "y"], ["ix", "iy"], "rate").collect()}
    assert [f for f, r in found.items() if r.spike] == [100]
    assert found[95].contaminated and found[105].contaminated and not found[100].contaminated and not found[106].contaminated
    assert found[100].r_y == pytest.approx(1.5)


def test_rotations_survive_a_change_of_sign(spark):
    draw = np.random.default_rng(0)
    q = draw.normal(size=(60, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    rows = [("a", float(i * 10), tuple(map(float, v)), tuple(map(float, -v if i % 7 == 0 else v))) for i, v in enumerate(q)]
    part = "struct<w:double,x:double,y:double,z:double>"
    df = spark.createDataFrame(rows, f"c string, t double, q {part}, r {part}")
    at = spark.createDataFrame([("a", t) for t in (-5.0, 0.0, 3.0, 10.0, 333.3, 590.0, 700.0)], "c string, t double")
    one = {r.t: r.q for r in asof.slerped(df, at, K, "t", "q").collect()}
    two = {r.t: r.r for r in asof.slerped(df, at, K, "t", "r").collect()}
    for t in one:
        a, b = np.array(one[t]), np.array(two[t])
        assert abs(abs(a @ b) - 1) < 1e-12 and abs(np.linalg.norm(a) - 1) < 1e-12
    assert abs(np.array(one[-5.0]) @ q[0]) == pytest.approx(1) and abs(np.array(one[700.0]) @ q[-1]) == pytest.approx(1)


def test_exponential_inverts_logarithm(spark):
    df = spark.createDataFrame([((3.0, -4.0, 5.0),), ((0.0, 0.0, 0.0),), ((100.0, 20.0, -60.0),)], "v struct<x:double,y:double,z:double>")
    for r in df.select("v", Q.rotation_vector(Q.from_rotation_vector(F.col("v"))).alias("w")).collect():
        assert tuple(r.w) == pytest.approx(tuple(r.v), abs=1e-9)
    (r,) = df.limit(1).select(Q.soft_limited(Q.vec(3.0, 4.0, 0.0), 1.0).alias("s")).collect()
    assert np.linalg.norm(tuple(r.s)) <= 1 and r.s.x / r.s.y == pytest.approx(3 / 4)


def test_gate_and_zero_net(spark):
    rows = spark.createDataFrame([("a", i) for i in range(100)], "c string, frame int")
    spans = spark.createDataFrame([("a", 20, 60), ("a", 50, 70)], "c string, a int, b int")
    met = gates.within(rows, spans, K, "frame", "a", "b", 16)
    assert met.count() == 41 + 21
    gate = {r.frame: r.g for r in met.groupBy("frame").agg(F.max(gates.cosine_gate(F.col("frame").cast("double"), F.col("a").cast("double"), F.col("b").cast("double"), 5.0)).alias("g")).collect()}
    assert gate[20] == 0 and gate[70] == 0 and all(gate[i] == 1 for i in range(25, 56)) and max(gate.values()) <= 1


def test_fits(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(500, 3))
    y = x @ [0.2, -0.5, 0.9]
    df = spark.createDataFrame([("a", *map(float, v), float(w), 50.0) for v, w in zip(x, y)], "k string, x double, y double, z double, i double, rate double")
    (r,) = stats.plane_fit(df, ["k"], ("x", "y", "z"), "i").collect()
    assert (r.a, r.b, r.c) == pytest.approx((0.2, -0.5, 0.9))
    g = df.withColumn("i", F.col("x") * 0.8)
    (r,) = stats.scalar_gain(g, ["k"], "x", "i", F.col("rate") >= 20, 200).collect()
    assert (r.gain, r.corr, r.n) == (pytest.approx(0.8), pytest.approx(1), 500)
    (r,) = stats.scalar_gain(g, ["k"], "x", "i", F.col("rate") < 20, 200).collect()
    assert (r.gain, r.corr, r.n) == (1.0, None, 0)


@pytest.mark.parametrize("kind,hz,through,stopped", [("low", 4.0, 0.5, 15.0), ("high", 4.0, 15.0, 0.3), ("band", (2.0, 4.0), 2.83, 15.0)])
def test_filter_response(kind, hz, through, stopped):
    fps, t = 50.0, np.arange(2000) / 50.0
    sections = filters.butterworth(kind, hz, fps)
    inner = slice(400, 1600)
    gain = lambda f: np.std(filters.zero_phase(np.sin(2 * np.pi * f * t), sections)[inner]) / np.std(np.sin(2 * np.pi * f * t)[inner])
    assert gain(through) == pytest.approx(1, abs=0.02) and gain(stopped) < 0.02
    for edge in np.atleast_1d(hz):  # half of the power twice: forward and backward
        assert gain(edge) == pytest.approx(0.5, abs=0.03)


def test_filters_of_flat_and_pulsed_series():
    low = filters.butterworth("low", 4.0, 50.0)
    assert filters.zero_phase(np.full(300, 2.5), low) == pytest.approx(np.full(300, 2.5))
    pulse = np.zeros(1000)
    pulse[-1] = 1
    assert abs(filters.spectral_gain(pulse, 50.0, filters.GAIN_HZ, filters.GAIN_ROLL, reflect=100)[0]) < 1e-3
    hz, p = filters.power(np.sin(2 * np.pi * 10 * np.arange(1000) / 50.0), 50.0)
    assert abs(hz[np.argmax(p)] - 10) < 0.5


def test_mapped_filters_do_not_depend_on_chunks(spark):
    x = [float(np.sin(i / 9) + (i * 37 % 11) / 50) for i in range(3000)]
    low = filters.butterworth("low", 4.0, 50.0)
    f = lambda v: filters.zero_phase(v, low)
    whole = values(filters.mapped(series(spark, x), K, "frame", "x", "y", f), "y")
    assert values(filters.mapped(series(spark, x), K, "frame", "x", "y", f, chunk=1000, halo=300), "y") == pytest.approx(whole, abs=1e-6)


def test_spectral_gain_of_series_longer_than_a_chunk(spark, monkeypatch):
    n = 20_000
    x = np.random.default_rng(4).random(n) + np.linspace(0, 50, n)
    rows = series(spark, x.tolist()).withColumnRenamed("c", "clip_id").withColumn("ix", F.col("x"))
    monkeypatch.setattr(filtering, "sig", lambda *_: rows)
    monkeypatch.setattr(filtering, "duo", lambda *_: rows)
    found = [values(q(spark, ""), "y") for q in (filtering.w13_spectral_gain, filtering.w14_reflected_gain)]
    assert found[0] == pytest.approx(filters.spectral_gain(x, 50.0, filters.GAIN_HZ, filters.GAIN_ROLL), abs=1e-6)
    assert found[1] == pytest.approx(filters.spectral_gain(x, 50.0, filters.GAIN_HZ, filters.GAIN_OTHER, reflect=100), abs=1e-6)


@pytest.mark.parametrize("n", [50, 128, 1000, 1050, 1090, 3000])
def test_band_share_does_not_depend_on_chunks(spark, n):
    x = np.random.default_rng(n).random(n) + np.sin(np.arange(n) ** 1.5 / 90)
    hz, p = filters.power(x, 50.0)
    expected = p[(hz >= 15) & (hz <= 25)].sum() / p[(hz >= 2) & (hz <= 6)].sum()
    (r,) = filters.band_share(series(spark, x.tolist()), K, "frame", "x", 50.0, (15.0, 25.0), (2.0, 6.0), chunk=512).collect()
    assert r.share == pytest.approx(expected, abs=1e-9)


def test_gap_fill_and_as_of_are_linear_in_a_series(spark):
    """One series of 200,000 rows; frames that are evaluated anew for each row would take hours."""
    n = 200_000
    s = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("f"), (F.col("id") * 10).cast("double").alias("t"), F.when(F.col("id") % 1000 == 7, F.col("id") * 3.0).alias("v"))
    filled = s.select("f", W.filled("v", ["k"], "f").alias("v"))
    wrong = F.abs(F.col("v") - 3 * F.greatest(F.lit(7), F.least(F.col("f"), F.lit(n - 993)))) > 1e-6
    assert filled.where(wrong | F.col("v").isNull()).count() == 0 and filled.count() == n
    line = s.select("k", "t", (F.col("t") * 2).alias("v"))
    met = asof.interpolated(line, s.select("k", (F.col("t") - 3).alias("t"), F.col("t").alias("own")), ["k"], "t", "v")
    assert met.where(F.abs(F.col("v") - 2 * F.greatest(F.col("own") - 3, F.lit(0.0))) > 1e-6).count() == 0 and met.count() == n


def test_axis_fit_and_its_rules(spark):
    draw = np.random.default_rng(2)
    v = draw.normal(size=(2000, 3))
    axis = np.array([0.2, -0.3, 0.9])
    rows = [("good", *map(float, x), float(x @ axis)) for x in v] + [("noise", *map(float, x), float(draw.normal())) for x in v] + [("few", *map(float, x), float(x @ axis)) for x in v[:199]]
    df = spark.createDataFrame(rows, "k string, x double, y double, z double, img double")
    found = {r.k: r for r in stats.axis_fit(df, ["k"], ("x", "y", "z"), "img", F.lit(True), 0.9, otherwise=(0.0, 3.0, 4.0)).collect()}
    assert np.allclose([found["good"][f"a{k}"] for k in "xyz"], axis / np.linalg.norm(axis), atol=1e-9) and found["good"].gain == pytest.approx(np.linalg.norm(axis))
    for k in ("noise", "few"):
        assert (found[k].ax, found[k].ay, found[k].az, found[k].gain) == pytest.approx((0, 0.6, 0.8, 5.0))
    assert found["noise"].corr < 0.9 and found["few"].corr is None
    assert [r.ax for r in stats.axis_fit(df.where("k = 'noise'"), ["k"], ("x", "y", "z"), "img", F.lit(True), 0.8).collect()] == [None]
