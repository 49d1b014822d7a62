"""Second-by-second paths, motions at frames and matched readings against plain numpy."""

import numpy as np
import pytest

from tidemark.operators import fits, verification

from .test_fits import attitudes, slerp

K = ["k"]


def test_second_paths(spark):
    draw = np.random.default_rng(2)
    x = {"a": draw.normal(0, 1, 57), "b": draw.normal(5, 1, 23), "c": draw.normal(0, 1, 2)}
    x["a"][[3, 20]] = np.nan
    rows = [(k, i, None if np.isnan(v) else float(v), 2.0) for k, xs in x.items() for i, v in enumerate(xs)]
    d = spark.createDataFrame(rows, "k string, frame int, x double, one double")
    got = {(r.k, r.frame): r for r in verification.second_paths(d, K, "frame", ["x", "one"], 9.7).collect()}
    assert len(got) == len(rows)
    for k, xs in x.items():
        for lo in range(0, len(xs), 10):
            y = np.cumsum(np.nan_to_num(xs[lo : lo + 10]))
            i = np.arange(len(y))
            want = y - np.polyval(np.polyfit(i, y, 2), i) if len(y) > 3 else np.zeros(len(y))
            for j, w in enumerate(want):
                r = got[k, lo + j]
                assert (r.x, r.one, r.second) == (pytest.approx(w, abs=1e-9), pytest.approx(0, abs=1e-9), lo // 10)


def test_series_at_frames(spark):
    t = np.arange(300) * 0.005
    samples, q = attitudes(spark, t, np.column_stack([9 * np.sin(t * 3), 5 * t, -3 * np.cos(t)]))
    n, fps = 80, 50.0  # beyond the samples too, whose last one holds there
    micro = samples.selectExpr("k", "t * 1e6 AS t", "q")
    found = verification.series_at_frames(micro, spark.createDataFrame([("a", n)], "k string, n long"), K, fps, 2.5)
    rows = sorted(found.collect(), key=lambda r: r.frame)
    want = slerp(t, q, np.arange(n + 1) / fps + 0.0025)
    got = np.array([[r.q[p] for p in "wxyz"] for r in rows])
    assert [r.frame for r in rows] == list(range(n + 1)) and rows[-1].v is None
    assert np.abs(np.abs((got * want).sum(1)) - 1).max() < 1e-10
    step = fits._log(fits._mul(fits._inverse(want[:-1]), want[1:]))
    assert np.abs(np.array([[r.v[a] for a in "xyz"] for r in rows[:-1]]) - step).max() < 1e-5


def test_parse_check(spark):
    kind = "struct<w:double,x:double,y:double,z:double>"
    one = lambda x: (1.0, x, 0.0, 0.0)
    ours = spark.createDataFrame([("a", 10.9, one(0.0)), ("a", 20.0, one(0.0)), ("a", 30.0, one(0.0)), ("a", 50.0, one(0.0)), ("b", 10.0, one(0.0))], f"k string, t double, q {kind}")
    theirs = spark.createDataFrame([("a", 10, one(0.1)), ("a", 11, one(9.0)), ("a", 21, one(0.3)), ("a", 19, one(9.0)), ("a", 29, one(-0.2)), ("a", 52, one(9.0))], f"k string, key long, q {kind}")
    got = {r.k: (r.n, r.matched, r.worst) for r in verification.parse_check(ours, theirs, K).collect()}
    assert got == {"a": (4, 3, 0.3), "b": (1, 0, None)}
