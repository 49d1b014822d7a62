"""Filters in chunks against the same rules over whole runs in plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import corrections, filters, timing
from tidemark.plans import filtering

SF = "/root/testdata/sf0.01"


def table(spark, told, seen, calm):
    rows = [("a", i, float(x), None if np.isnan(y) else float(y), bool(c)) for i, (x, y, c) in enumerate(zip(told, seen, calm))]
    return spark.createDataFrame(rows, "k string, f int, told double, seen double, calm boolean")


def runs(ok, least):
    edges = np.flatnonzero(np.diff(np.concatenate([[0], ok.astype(int), [0]])))
    return [np.arange(a, b) for a, b in zip(edges[::2], edges[1::2]) if b - a >= least]


@pytest.fixture(scope="module")
def motion():
    draw = np.random.default_rng(2)
    told = np.cumsum(draw.normal(size=3000)) * 0.1 + np.sin(np.arange(3000) * 0.4)
    seen = told * 0.9 + draw.normal(size=3000) * 0.05
    seen[::97] = np.nan
    calm = np.arange(3000) % 800 < 700
    return told, seen, calm


def test_band_gain_is_that_of_whole_runs(spark, motion):
    told, seen, calm = motion
    band = filters.butterworth("band", (2.0, 4.0), 50.0)
    x, y = (np.concatenate([filters.zero_phase(v[r], band)[15:-15] for r in runs(calm & ~np.isnan(seen), 64)]) for v in (told, seen))
    (row,) = filters.band_gain(table(spark, *motion), ["k"], "f", "told", "seen", F.col("calm"), 50.0).collect()
    assert row.gain == pytest.approx(float(x @ y / (x @ x))) and 0.8 < row.gain < 1
    (row,) = filters.band_gain(table(spark, told, seen * 5, calm), ["k"], "f", "told", "seen", F.col("calm"), 50.0).collect()
    assert row.gain == 1.0
    (row,) = filters.band_gain(table(spark, *(x[:200] for x in motion)), ["k"], "f", "told", "seen", F.col("calm"), 50.0).collect()
    assert row.gain == 1.0


def test_spectral_keep_is_that_of_whole_runs(spark, motion):
    told, seen, calm = motion
    seen = np.nan_to_num(seen)
    a = b = 0
    for r in runs(calm, 128):
        for which in (0, 1):
            x, power = (told, seen)[which][r], []
            for i in range(0, len(x) - 127, 64):
                t = np.arange(128)
                p = x[i : i + 128] - np.polyval(np.polyfit(t, x[i : i + 128], 1), t)
                power.append(np.abs(np.fft.rfft(p * (0.5 - 0.5 * np.cos(2 * np.pi * t / 128)))) ** 2)
            mean = np.mean(power, 0) * len(r)
            a, b = (a + mean, b) if which == 0 else (a, b + mean)
    hz = np.array(filters.GAIN_HZ, float)
    keep = np.where(hz < 4, 1.0, np.interp(hz, np.fft.rfftfreq(128, 1 / 50), np.clip(b / a, 0.03, 1)))
    for chunk in (filters.CHUNK, 256):  # runs in one piece, and cut
        found = filters.spectral_keep(table(spark, told, seen, calm), ["k"], "f", "told", "seen", F.col("calm"), 50.0, chunk=chunk).orderBy("hz").collect()
        assert [r.hz for r in found] == list(hz) and [r.keep for r in found] == pytest.approx(list(keep))
    few = table(spark, *(x[:300] for x in (told, seen, calm)))
    assert filters.spectral_keep(few, ["k"], "f", "told", "seen", F.col("calm"), 50.0).count() == 0


def test_smoothed_rotations(spark):
    n = 1500
    half = np.radians(np.arange(n) * 0.1 + np.sin(np.arange(n))) / 2
    whole = np.column_stack([np.cos(half), np.sin(half) * 0.6, np.zeros(n), np.sin(half) * 0.8])
    jumps = np.where(np.arange(n) % 13 == 5, -1, 1)
    low = filters.butterworth("low", 2.0, 50.0)
    smooth = np.column_stack([filters.zero_phase(c, low) for c in whole.T])
    smooth /= np.linalg.norm(smooth, axis=1, keepdims=True)
    rows = [("a", i, tuple(map(float, q * s * 3))) for i, (q, s) in enumerate(zip(whole, jumps))]
    df = spark.createDataFrame(rows, "k string, f int, q struct<w: double, x: double, y: double, z: double>")
    found = [tuple(r.q) for r in filters.smoothed_rotations(df, ["k"], "f", "q", 50.0, 2.0).orderBy("f").collect()]
    assert np.allclose(found, smooth * np.sign(jumps[0]), atol=1e-9)
    spin = spark.createDataFrame([("a", i, (float(np.cos(i * 1.5)), float(np.sin(i * 1.5)), 0.0, 0.0)) for i in range(200)], df.schema)
    with pytest.raises(Exception, match="cancel"):
        filters.smoothed_rotations(spin, ["k"], "f", "q", 50.0, 0.5).collect()


def test_queries_have_rows(spark):
    gains = {r.clip_id: r.gain for r in filtering.a08_band_gain(spark, SF).collect()}
    assert len(gains) == 5 and all(0.5 < g <= 1 for g in gains.values())
    keep = filtering.a09_spectral_keep(spark, SF).collect()
    assert len(keep) == 5 * 14 and any(r.keep < 1 for r in keep) and all(r.keep == 1 for r in keep if r.hz < 4)
    assert {(r.kind, r.band) for r in filtering.a26_band_table(spark, SF).collect()} == {(k, b) for k in ("told", "seen") for b in ("1-4", "4-8", "8-24.5", "step")}
    assert filtering.w15_smoothed_rotations(spark, SF).count() == 10_000


def test_too_few_values_are_an_error(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("b", 0, 1.0), ("b", 1, 3.0)], "k string, f int, v double")
    assert corrections.whole(df.where("k = 'b'"), ["k"], "f", ["v"]).count() == 2
    with pytest.raises(Exception, match="too few values on v"):
        corrections.whole(df, ["k"], "f", ["v"]).collect()


def test_an_unknown_mode_is_an_error(spark):
    with pytest.raises(ValueError, match="other"):
        timing.frame_shifts(spark.range(1), ["other"], ["k"], "f", "e", 1.0)
