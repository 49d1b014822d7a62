"""Rates, fast parts and turning points of exported paths against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import exports, filters, fits
from tidemark.plans import exports as plans

N = 400


def test_exports(spark):
    draw = np.random.default_rng(3)
    t = np.arange(N) / 50
    paths = {"org": np.column_stack([10 * np.sin(t * 2), 5 * np.cos(t), 8 * np.sin(t * 1.3)]) + draw.normal(0, 0.1, (N, 3)), "stab": np.column_stack([3 * np.sin(t), 2 * np.cos(t), t])}
    q = {n: fits._exp(v) for n, v in paths.items()}
    q["org"][50] *= -3  # neither sign nor length matter
    kind = "struct<w:double,x:double,y:double,z:double>"
    df = spark.createDataFrame([("a", i, *(tuple(map(float, q[n][i])) for n in paths)) for i in range(N)], f"k string, frame int, org {kind}, stab {kind}")
    rows = exports.flattened(df, ["k"], "frame", ["org", "stab"], 50.0)
    found = rows.orderBy("frame").collect()
    windows = spark.createDataFrame([("a", 0, 0, 99), ("a", 1, 60, 399)], "k string, run int, a int, b int")
    told = {(r.run, r.path): r for r in exports.measures(rows, windows, ["k"], "frame", ["org", "stab"], 50.0).collect()}
    turns = {(r.run, r.angle): r for r in exports.turning_points(rows, windows, ["k"], "frame", {"org_yaw": 1, "stab_roll": -1}).collect()}
    high = filters.butterworth("high", 4.0, 50.0)
    for n in paths:
        unit = q[n] / np.linalg.norm(q[n], axis=1, keepdims=True)
        rate = fits._log(fits._mul(fits._inverse(unit[:-1]), unit[1:])) * 50
        assert np.allclose([[r[f"{n}_rate_{k}"] for k in "xyz"] for r in found[:-1]], rate, atol=1e-8) and found[-1][f"{n}_rate_x"] is None
        assert np.allclose([[r[f"{n}_{k}"] for k in "wxyz"] for r in found], unit)
        fast = np.linalg.norm(np.column_stack([filters.zero_phase(x, high, 9) for x in rate.T]), axis=1)
        for run, a, b in ((0, 0, 100), (1, 60, 399)):
            r = told[run, n]
            assert r.rms == pytest.approx(np.sqrt(np.mean(np.sum(rate[a:b] ** 2, 1)))) and r.fast_rms == pytest.approx(np.sqrt(np.mean(fast[a:b] ** 2)))
            assert r.fast_peak == pytest.approx(fast[a:b].max()) and r.peak_frame == a + int(np.argmax(fast[a:b]))
    for (run, angle), r in turns.items():
        a, b = ((0, 100), (60, 400))[run]
        v = np.array([x[angle] for x in found])[a:b]
        i = int(np.argmax(v if angle == "org_yaw" else -v))
        assert (r.frame, r.value, r.back) == (a + i, pytest.approx(v[i]), pytest.approx(v[-1] - v[i], abs=1e-9))
    assert len(turns) == 4


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """(folder, rows by series) of 250 frames a series, the last without a rate."""
    folder = str(tmp_path_factory.mktemp("events"))
    lines = [(i, 1.7e9 + i * 7.0, ("click", "view")[i % 2], float(i * 37 % 500)) for i in range(500)]
    df = spark.createDataFrame(lines, "event_id long, at double, event_type string, value double")
    df.select("event_id", F.timestamp_seconds("at").cast("timestamp_ntz").alias("ts"), "event_type", "value").write.parquet(f"{folder}/events.parquet")
    of = {}
    for r in plans._paths(spark, folder)[0].orderBy("frame").collect():
        of.setdefault(r.clip_id, []).append(r)
    return folder, of


def test_measures_over_events(spark, events):
    folder, of = events
    found = plans.k15_export_measures(spark, folder).collect()
    assert sorted((r.clip_id, r.run, r.path) for r in found) == [(c, k, p) for c in ("click", "view") for k in range(3) for p in ("org", "stab")]
    for r in found:
        own = of[r.clip_id][r.run * 100 : min(r.run * 100 + 100, 249)]
        v = np.array([[x[f"{r.path}_rate_{k}"] for k in "xyz"] for x in own])
        assert r.rms == pytest.approx(np.sqrt(np.mean(np.sum(v * v, 1))), abs=1e-6) and own[0].frame <= r.peak_frame <= own[-1].frame


def test_turning_points_over_events(spark, events):
    folder, of = events
    turns = plans.k15_turning_points(spark, folder).collect()
    assert len(turns) == 2 * 3 * 4
    for r in turns:
        own = of[r.clip_id][r.run * 100 : r.run * 100 + 100]
        v = np.array([x[r.angle] for x in own]) * (1 if r.angle.endswith("yaw") else -1)
        assert (r.frame, r.value) == (own[int(np.argmax(v))].frame, pytest.approx(own[int(np.argmax(v))][r.angle], abs=1e-6))
