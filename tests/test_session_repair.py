"""The repair of a session against the same rules in plain numpy; its targets are held in test_fits.py."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fits, session_repair
from tidemark.operators.session_repair import GUARDS, Settings

from .test_fits import attitudes, exp, slerp

K, DT = ["k"], 0.02
TARGETS = {}  # of each model, as they don't depend on its other settings
SPANS = "k string, run int, lo double, hi double"
EVENTS = [("a", 1, 0.901, 1.1, "large_impulse"), ("a", 2, 1.05, 1.3, "gyro_fault"), ("a", 3, 2.0, 2.2, None), ("a", 4, 2.0, 2.2, "large_impulse"), ("a", 5, 0.02, 0.15, "large_impulse"), ("a", 6, 4.2, 4.4, "micro_jitter"), ("a", 7, 3.6, 3.604, "gyro_fault")]


@pytest.fixture(scope="module")
def session(spark):
    draw = np.random.default_rng(3)
    t = np.arange(1000) * 0.005
    v = np.column_stack([8 * np.sin(t * 3), 5 * np.cos(t * 2), 4 * np.sin(t)]) + draw.normal(0, 0.01, (1000, 3))
    for _, _, lo, hi, _ in EVENTS:
        v[(t > lo) & (t < hi)] += draw.normal(0, 1.5, 3)
    samples, q = attitudes(spark, t, v)
    samples = samples.withColumn("_priority", F.lit(7)).withColumn("gate", F.lit("mine"))  # names that the repair uses too
    n = 248
    at = (np.arange(n) + 0.5) * DT
    told, seen = (np.column_stack([40 * np.sin(at * 2 + k) for k in range(3)]) + draw.normal(0, x, (n, 3)) for x in (6.0, 9.0))
    seen[[40, 111]] = np.nan
    confidence = np.where(np.arange(n) % 11 == 0, 0.1, 0.9)
    f = lambda x: None if np.isnan(x) else float(x)
    rates = spark.createDataFrame([("a", i, float(at[i]), *map(f, told[i]), *map(f, seen[i]), float(confidence[i])) for i in range(n)], "k string, frame int, t double, gx double, gy double, gz double, sx double, sy double, sz double, confidence double")
    maps = spark.createDataFrame([("a", [1, 0, 2], [1, -1, 1])], "k string, p array<int>, s array<int>")
    events = spark.createDataFrame(EVENTS, SPANS + ", kind string")
    return samples, q, t, events, rates, maps, at, told, seen, confidence


def soft(v, most):
    r = np.linalg.norm(v, axis=1, keepdims=True) / most
    return v * np.where(r > 0, np.tanh(r) / np.maximum(r, 1e-300), 1)


def plainly(spark, session, s, guards):
    """(q, applied, repairs) by one loop over events and arrays of all samples."""
    samples, q, t, events, rates, maps, at, told, seen, confidence = session
    whole, bridge = (len(at) + 1) * DT, s.model == "bridge"
    windows = {}
    for _, run, lo, hi, kind in EVENTS:
        more = (hi - lo) / 2 * (s.bridge_range - 1) if bridge else s.repair_margin
        windows[run] = (max(0.0, lo - more), min(whole, hi + more), kind)
    pick = lambda shown: spark.createDataFrame([("a", r, a, b) for r, (a, b, k) in windows.items() if (k in s.detail_kinds and not bridge) == shown] or [], SPANS)
    if bridge not in TARGETS:
        slim = samples.select("k", "t", "q")
        curve, curves = fits.context_curves(slim, pick(False), events, K, s.context, s.points, s.degree, -1.0 if bridge else 1.0)
        shown, _ = fits.detail_targets(slim, pick(True), rates, maps, K, DT)
        TARGETS[bridge] = curve.collect() + shown.collect(), {r.run: r.rms for r in curves.collect()}
    rows, rms = TARGETS[bridge]
    target = {}
    for r in rows:
        target.setdefault(r.run, []).append((r.t, [r.q[c] for c in "wxyz"]))
    applied, priority, told_of = np.zeros_like(q[:, 1:]), np.zeros(len(t)), {}
    dirty = np.any([(at >= lo) & (at <= hi) for _, _, lo, hi, _ in EVENTS], axis=0)
    sound = ~dirty & (confidence >= 0.2) & ~np.isnan(seen).any(1)
    for run in sorted(windows):
        lo, hi, _ = windows[run]
        fade = min(s.fade + (s.margin if bridge else 0), (hi - lo) / 2)
        gate = 0.5 - 0.5 * np.cos(np.pi * np.clip(np.minimum(t - lo, hi - t) / fade, 0, 1))
        on, goals = np.flatnonzero(gate > 0), dict(target[run])
        goal = np.array([goals[x] for x in t[on]])
        v = fits._log(fits._mul(fits._inverse(q[on]), goal))
        frame = at[(at >= lo - max(2 * DT, s.margin)) & (at <= hi + max(2 * DT, s.margin))]
        move = v * gate[on][:, None] * s.blend
        fast = 0.0
        if len(on) >= 3 and len(frame) >= 3:
            fast = np.sqrt((np.gradient(np.column_stack([np.interp(frame, t[on], c, left=0, right=0) for c in move.T]), frame, axis=0) ** 2).sum(1).mean())
        near = sound & (((at >= lo - s.context) & (at < lo)) | ((at > hi) & (at <= hi + s.context)))
        motion = np.sqrt((((told + seen)[near] / 2) ** 2).sum(1).mean()) if near.any() else 0.0
        apart = np.sqrt(((told - seen)[near] ** 2).sum(1).mean()) if near.any() else 0.0
        a, b, c = (x if g in guards else 0.0 for g, x in (("rate", fast), ("agreement", apart), ("motion", motion)))
        scale = (1 + (a / 5) ** 4) ** -0.25 / np.hypot(1, max(0, b - 6) / 10) / np.hypot(1, c / 80 * max(0, a - 4) / 4) * np.exp(-2 * max(0, c - 110) / 80 * max(0, a - 3.5) / 3.5)
        scale = min(1.0, max(0.12, scale))
        quality = (1 + (rms[run] / 0.25) ** 4) ** -0.25 if "quality" in guards and rms.get(run) is not None else 1.0
        gain = s.blend * scale * quality
        told_of[run] = (fast, near.sum(), motion, apart, scale, quality, gain)
        better = gate[on] * gain > priority[on]
        applied[on[better]] = (v * gate[on][:, None] * gain)[better]
        priority[on[better]] = (gate[on] * gain)[better]
    applied = soft(applied, s.most)
    return fits._mul(q, exp(applied)), applied, priority, told_of


@pytest.mark.parametrize("s,guards", [(Settings(), ()), (Settings(guards=GUARDS, blend=0.8, most=0.7), GUARDS), (Settings(model="bridge"), GUARDS)])
def test_repair_matches_plain_numpy(spark, session, s, guards):
    samples, _, t, events, rates, maps, *_ = session
    want, applied, priority, told_of = plainly(spark, session, s, guards)
    found, repairs = session_repair.session_repair(samples, events, rates, maps, K, DT, settings=s)
    rows = sorted(found.collect(), key=lambda r: r.t)
    assert found.columns[:5] == ["k", "t", "q", "_priority", "gate"] and {(r["_priority"], r["gate"]) for r in rows} == {(7, "mine")}
    assert [r.t for r in rows] == t.tolist() and [r.applied is not None for r in rows] == (priority > 0).tolist()
    got = np.array([[r.q[c] for c in "wxyz"] for r in rows])
    assert np.abs(got - want).max() < 1e-9
    turn = np.array([[0.0] * 3 if r.applied is None else [r.applied[c] for c in "xyz"] for r in rows])
    assert np.abs(turn - applied).max() < 1e-8 and np.linalg.norm(turn, axis=1).max() <= s.most
    told = {r.run: r for r in repairs.collect()}
    assert set(told) == set(told_of)
    for run, w in told_of.items():
        r = told[run]
        assert (r.predicted, r.frames, r.motion, r.disagreement, r.scale, r.quality, r.gain) == pytest.approx(w, rel=1e-6, abs=1e-9)
    assert (told[2].method, told[1].method) == (("bridge", "bridge") if s.model == "bridge" else ("detail", "curve"))
    if guards:
        assert min(x[4] for x in told_of.values()) < 0.9  # a guard counts


def test_no_events_and_wrong_ones(spark, session):
    samples, _, t, events, rates, maps, *_ = session
    found, repairs = session_repair.session_repair(samples, events.where("false"), rates, maps, K, DT)
    assert found.where("applied is null").count() == len(t) and repairs.count() == 0
    for lo, hi in ((1.0, 0.9), (-0.1, 0.2), (4.9, 5.2), (None, 1.0), (1.0, None)):
        with pytest.raises(Exception, match="bounds"):
            session_repair.session_repair(samples, spark.createDataFrame([("a", 1, lo, hi, "x")], SPANS + ", kind string"), rates, maps, K, DT)
    with pytest.raises(ValueError):
        session_repair.session_repair(samples, events, rates, maps, K, DT, settings=Settings(model="other"))


def test_timings_and_velocity(spark, session):
    samples, q, t, _, rates, maps, *_ = session
    framed = samples.withColumn("frame", F.floor(F.col("t") / DT + 1e-6).cast("int")).withColumn("index", F.lit(0))
    shifts = spark.createDataFrame([("a", i, None if i == 9 else float(1000 + i)) for i in range(250)], "k string, frame int, shift_us double")
    got = {}
    for r in session_repair.timed_variants(framed, shifts, K, -6000.0).collect():
        got.setdefault(r.variant, []).append((r.t, r.frame, [r.q[c] for c in "wxyz"]))
    known = [1000 + i for i in range(250) if i != 9]
    by = {"none": lambda f: 0.0, "mean": lambda f: np.median(known), "frame": lambda f: 0.0 if f == 9 else 1000.0 + f, "manual": lambda f: -6000.0}
    assert set(got) == set(by)
    for name, rows in got.items():
        rows.sort()
        want = slerp(t, q, np.array([x + by[name](f) / 1e6 for x, f, _ in rows]))
        assert len(rows) == len(t) and np.abs(np.abs(np.sum(np.array([x for *_, x in rows]) * want, 1)) - 1).max() < 1e-10
    speed = {r.frame: (r.x, r.y, r.z) for r in session_repair.frame_velocity(samples, rates, maps, K, 1 / DT, 0.001).collect()}
    for f in (0, 77, 240):
        a, b = slerp(t, q, np.array([f * DT + 0.001, (f + 1) * DT + 0.001]))
        v = fits._log(fits._mul(fits._inverse(b[None]), a[None]))[0] / DT
        assert speed[f] == pytest.approx((v[1], -v[0], v[2]), abs=1e-6)
