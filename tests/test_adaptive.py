"""Corrections and flags against the same rules over whole series in plain numpy."""

import numpy as np
import pytest

from tidemark.operators import adaptive, filters
from tidemark.plans import adaptive as plans

FPS, N = 50.0, 3000
COLUMNS = ["x", "y", "z", "ix", "iy", "iz", "curl", "points", "rate", "valid", "rx", "ry", "rr"]


def passed(kind, hz, v):
    return filters.zero_phase(np.nan_to_num(v), filters.butterworth(kind, hz, FPS))


def rms(v, win):
    return np.sqrt(np.convolve(np.asarray(v) ** 2, np.ones(win) / win, mode="same"))


def grown(mask, reach):
    return np.convolve(mask.astype(int), np.ones(2 * reach + 1, int), mode="same") > 0


def gain(told, seen, ok):
    edges = np.flatnonzero(np.diff(np.concatenate([[0], ok.astype(int), [0]])))
    runs = [np.arange(a, b) for a, b in zip(edges[::2], edges[1::2]) if b - a >= 64]
    if sum(len(r) - 30 for r in runs) < 300:
        return 1.0
    a, b = (np.concatenate([passed("band", (2.0, 4.0), v[r])[15:-15] for r in runs]) for v in (told, seen))
    g = a @ b / (a @ a)
    return g if 0.5 < g < 2 else 1.0


@pytest.fixture(scope="module")
def motion():
    draw = np.random.default_rng(5)
    told = np.sin(np.arange(N)[:, None] * [0.31, 0.37, 0.41]) * 0.4 + draw.normal(size=(N, 3)) * 0.03
    seen = told * 1.1 + draw.normal(size=(N, 3)) * 0.026  # errors a second on the ramp of the gate
    told[500] += [0.6, 0, 0]
    told[700] -= [0, 0.6, 0]
    seen[::97] = np.nan
    curl = np.nan_to_num(seen[:, 2]) + draw.normal(size=N) * 0.01
    curl[1500:1600] += draw.normal(size=100)
    points = np.where(np.arange(N) % 611 < 5, 10, 400)
    rate = np.where(np.arange(N) // 100 % 7 == 3, 80.0, 10.0)
    left = draw.normal(size=(N, 3))
    left[2000:2030] *= 30
    left[2500] = np.nan
    return {**dict(zip("xyz", told.T)), **dict(zip(("ix", "iy", "iz"), seen.T)), "curl": curl, "points": points, "rate": rate, "valid": np.arange(N) >= 10, **dict(zip(("rx", "ry", "rr"), left.T))}


def table(spark, m):
    plain = lambda v: None if isinstance(v, float) and np.isnan(v) else v
    kinds = {"points": "int", "valid": "boolean"}
    return spark.createDataFrame([("a", i, *(plain(m[c][i].item()) for c in COLUMNS)) for i in range(N)], "k string, f int, " + ", ".join(f"{c} {kinds.get(c, 'double')}" for c in COLUMNS))


def test_roll_correction(spark, motion):
    told, seen, rate, valid = (motion[c] for c in ("z", "iz", "rate", "valid"))
    high = lambda v: passed("high", 4.0, v)
    has = ~np.isnan(seen) & valid
    kc = rms(np.where(has, high(seen) - high(motion["curl"]), 0), 25)
    ok = has & (kc < 0.03) & (motion["points"] >= 300) & ~grown(rate > 60, 5)
    g = gain(np.where(valid, told, 0), np.nan_to_num(seen), ok & (rate < 150))
    off = np.where(ok, np.nan_to_num(seen) / g - told, 0)
    error, calm = np.where(ok, high(seen) / g - high(np.where(valid, told, 0)), 0), ok & (rate < 45)
    per = np.array([1.4826 * np.median(np.abs(error[i : i + 50][calm[i : i + 50]])) if calm[i : i + 50].sum() > 25 else np.nan for i in range(0, N + 1, 50)])
    have, ramp = np.flatnonzero(~np.isnan(per)), lambda v: np.clip((v - 0.018) / 0.007, 0, 1)
    gates = []
    for i in range(len(per)):
        near = [j for j in sorted(have, key=lambda j: (abs(j - i), j))[:7] if abs(j - i) <= 20]
        gates.append(ramp(np.median(per[near])) if len(near) >= 5 else 0.0)
    gate = np.interp(np.arange(N) / FPS, np.arange(len(per)) + 0.5, np.array(gates) * ramp(np.median(per[have])))
    before = lambda c: np.concatenate([[0], np.cumsum(c)[:-1]])
    slow = ok & ~grown(rate > 30, 50)
    theta = passed("band", (4.0, 24.8), before(gate * np.where(ok, 1 / (1 + (rate / 120) ** 2), 0) * off)) + passed("band", (1.0, 4.0), before(gate * np.where(slow, 1 / (1 + (rate / 15) ** 2), 0) * off))
    df = table(spark, motion).withColumnsRenamed({"z": "told", "iz": "seen"})
    found = adaptive.roll_correction(df, ["k"], "f", FPS).orderBy("f").collect()
    assert len(found) == N and 0 < gate.max() and np.abs(theta).max() > 1e-3
    assert np.allclose([r.gate for r in found], gate, atol=1e-9) and np.allclose([r.theta for r in found], theta, atol=1e-8)


def test_flags(spark, motion):
    told, seen = (np.column_stack([motion[p + a] for a in "xyz"]) for p in ("", "i"))
    left = np.column_stack([motion[c] for c in ("rx", "ry", "rr")])
    rate, valid = motion["rate"], motion["valid"]
    high = lambda v: np.column_stack([passed("high", 4.0, c) for c in v.T])
    has = ~np.isnan(seen).any(1) & valid
    kc = rms(np.where(has, high(seen)[:, 2] - passed("high", 4.0, motion["curl"]), 0), 25)
    ok = has & (kc < 0.03) & (motion["points"] >= 300)
    image = seen / [gain(told[:, k], np.nan_to_num(seen[:, k]), ok & (rate < 150)) for k in range(3)]
    image[~has] = np.nan
    all_axes = lambda v: np.sqrt(sum(rms(c, 25) ** 2 for c in v.T))
    jitter = all_axes(np.where(has[:, None], high(image) - high(told), 0))
    masked = np.where(valid[:, None], told, 0)
    wide = np.pad(masked, ((2, 2), (0, 0)), mode="edge")
    r = told - np.median(np.stack([wide[i : i + N] for i in range(5)]), 0)
    jump = np.linalg.norm(r, axis=1)
    known = ~np.isnan(left).any(1)
    jerk = all_axes(np.column_stack([passed("band", (4.0, 24.5), c) for c in np.cumsum(np.where(known[:, None], left, 0), 0).T]))
    quiet = known & (rate < 45) & valid
    base = np.median(jerk[quiet]) if quiet.sum() > 100 else np.median(jerk[known])
    want = {
        "spike": (jump >= 0.35) & valid & (rate < 200),
        "confirmed": (np.nan_to_num(image - told) * r).sum(1) < -0.5 * jump**2,
        "tel_jitter": (jitter >= 0.05) & ok & (rate < 150) & valid,
        "image_bad": ~ok & valid & (rate < 100),
        "render_jerk": (jerk >= max(4, 3 * base)) & known & (rate < 60) & valid,
    }
    found = adaptive.flags(table(spark, motion), ["k"], "f", FPS).orderBy("f").collect()
    assert np.allclose([x.jerk for x in found], jerk, atol=1e-8) and np.allclose([x.jump for x in found], jump) and np.allclose([x.curl for x in found], kc, atol=1e-9)
    # filtered before or after the gain, gaps as zero either way
    assert np.flatnonzero(want["spike"]).tolist() == [500, 700]
    for name, flag in want.items():
        assert [x[name] for x in found] == flag.tolist() and flag.any(), name


def test_path_map_and_bands(spark, motion):
    path, render = (np.column_stack([motion[c] for c in names]) for names in ("xyz", ("rx", "ry", "rr")))
    render = np.nan_to_num(render) + path @ [[3.0, 0, 1], [0, 2, 0], [1, 0, 4]]
    df = table(spark, {**motion, **dict(zip(("rx", "ry", "rr"), render.T))})
    inner = lambda v, lo, hi: np.column_stack([passed("band", (lo, hi), c) for c in np.cumsum(v, 0).T])[10:-10]
    m = np.linalg.lstsq(inner(path, 0.3, 3.0), inner(render, 0.3, 3.0), rcond=None)[0]
    maps = adaptive.path_map(df, ["k"], "f", list("xyz"), ["rx", "ry", "rr"], FPS)
    assert np.allclose([[r.a, r.b, r.c] for r in sorted(maps.collect(), key=lambda r: ["rx", "ry", "rr"].index(r.axis))], m.T, atol=1e-6)
    bands = {(r.axis, r.band): (r.total, r.by_path, r.left) for r in adaptive.path_bands(df, maps, ["k"], "f", list("xyz"), ["rx", "ry", "rr"], FPS).collect()}
    told = path @ m
    for lo, hi in ((0.3, 1.0), (1.0, 4.0), (4.0, 8.0), (8.0, 24.5)):
        parts = [inner(v, lo, hi).std(0) for v in (render, told, render - told)]
        for k, axis in enumerate(("rx", "ry", "rr")):
            assert bands[axis, f"{lo:g}-{hi:g}"] == pytest.approx([p[k] for p in parts], rel=1e-5)


def test_denoised(spark, motion):
    found = adaptive.denoised(table(spark, motion), ["k"], "f", ["x", "z"], "rate", [filters.GAIN_OTHER, filters.GAIN_ROLL], FPS, gain=0.5).orderBy("f").collect()
    for axis, keep in (("x", filters.GAIN_OTHER), ("z", filters.GAIN_ROLL)):
        v = motion[axis]
        smooth = np.fft.irfft(np.fft.rfft(v) * np.interp(np.fft.rfftfreq(N, 1 / FPS), filters.GAIN_HZ, keep), N)
        change = 0.5 / (1 + (motion["rate"] / 80) ** 2) * (smooth - v)
        want = passed("band", (1.0, 24.8), np.concatenate([[0], np.cumsum(change)[:-1]]))
        assert np.allclose([r[axis] for r in found], want, atol=1e-8)


def test_queries_have_rows_of_each_kind(spark):
    found = plans.i11_flags(spark, "/root/testdata/sf0.01").toPandas()
    assert len(found) == 10_000 and found[["spike", "confirmed", "tel_jitter", "image_bad", "render_jerk"]].any().all()


def test_path_bands_by_chunks(spark):
    draw = np.random.default_rng(11)
    n, chunk, halo, render = {"a": 9000, "b": 4096, "c": 4099, "d": 15}, 2048, 1024, ["rx", "ry"]
    rows, series = [], {}
    for key, size in n.items():
        path = np.sin(np.arange(size)[:, None] * [0.05, 0.3, 0.9]) + draw.normal(size=(size, 3)) + 20  # whose sums rise far
        left = path @ [[3.0, 1], [0, 2], [1, 0]] + draw.normal(size=(size, 2))
        series[key] = path, left
        rows += [(key, i, *map(float, p), *map(float, r)) for i, (p, r) in enumerate(zip(path, left))]
    df = spark.createDataFrame(rows, "k string, f int, x double, y double, z double, rx double, ry double").repartition(5)
    inner = lambda v, lo, hi: np.column_stack([passed("band", (lo, hi), c) for c in np.cumsum(v, 0).T])[10:-10]
    maps = adaptive.path_map(df, ["k"], "f", list("xyz"), render, FPS, chunk=chunk, halo=halo)
    wanted = {k: np.linalg.lstsq(inner(p, 0.3, 3.0), inner(r, 0.3, 3.0), rcond=None)[0] for k, (p, r) in series.items() if len(p) > 20}
    given = maps.collect()
    assert len(given) == 6
    for r in given:
        assert np.allclose((r.a, r.b, r.c), wanted[r.k][:, render.index(r.axis)], atol=1e-6)
    # an axis of b has no map, one of c a map without numbers
    some = maps.where("k != 'b' or axis != 'ry'").selectExpr("k", "axis", *(f"case when k != 'c' or axis != 'rx' then {c} end as {c}" for c in "abc"))
    bands = adaptive.path_bands(df, some, ["k"], "f", list("xyz"), render, FPS, chunk=chunk, halo=halo)
    found = {(r.k, r.axis, r.band): (r.total, r.by_path, r.left) for r in bands.collect()}
    assert len(found) == 20 and not any(k[:2] == ("b", "ry") for k in found)
    for (k, axis, band), got in found.items():
        path, left = series[k]
        lo, hi = map(float, band.split("-"))
        of = render.index(axis)
        told = path @ wanted[k][:, of : of + 1]
        want = [inner(v, lo, hi).std() for v in (left[:, of : of + 1], told, left[:, of : of + 1] - told)]
        assert got == pytest.approx([want[0], 0, 0] if (k, axis) == ("c", "rx") else want, rel=1e-5)
    # a series is never sorted as a whole, and its rows are filtered once for the maps and once for all bands
    for df_, times in ((maps, 1), (bands, 2)):
        plan = df_._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and plan.count("FlatMapGroupsIn") == times


@pytest.mark.parametrize("n", [2, 5, 63, 64, 65, 700])
def test_sections_in_blocks_are_the_recursion(n):
    def plain(x, sections, pad=15):
        m = min(pad, len(x) - 1)
        y = np.concatenate([2 * x[0] - x[m:0:-1], x, 2 * x[-1] - x[-2 : -m - 2 : -1]])
        for _ in range(2):
            level = y[0]
            for b, a in sections:
                steady = b.sum() / a.sum() * level
                s1, s2, out = steady - b[0] * level, b[2] * level - a[2] * steady, []
                for v in y:
                    out.append(b[0] * v + s1)
                    s1, s2 = b[1] * v - a[1] * out[-1] + s2, b[2] * v - a[2] * out[-1]
                y, level = np.array(out), steady
            y = y[::-1]
        return y[m : m + len(x)]

    x = np.cumsum(np.random.default_rng(n).normal(size=(3, n)), 1) + 7
    for kind, hz in (("low", 4.0), ("high", 4.0), ("band", (0.3, 1.0)), ("band", (1.0, 24.8))):
        sections = filters.butterworth(kind, hz, FPS)
        found = filters.zero_phase(x, sections)
        assert np.allclose(found, [plain(v, sections) for v in x], atol=1e-9)
        assert np.allclose(filters.zero_phase(x[0], sections), found[0], atol=1e-12)
