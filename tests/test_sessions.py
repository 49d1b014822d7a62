"""Detection and measures of sessions on small made-up motions."""

import numpy as np
import pytest

from tidemark.operators import filters, sessions

DT = 0.02


def table(spark, gyro, source, out, conf=1.0):
    rows = [("a", i, *(None if np.isnan(v) else float(v) for v in (*g, *s, *t)), conf, 1.0) for i, (g, s, t) in enumerate(zip(gyro, source, out))]
    axes = ", ".join(f"{k}{a} double" for k in "gst" for a in "xyz")
    return spark.createDataFrame(rows, f"k string, f int, {axes}, conf_s double, conf_t double")


def motion(n=300):
    draw = np.random.default_rng(4)
    real = np.cumsum(draw.normal(size=(n, 3)), 0) * 0.2
    return real.copy(), real + draw.normal(size=(n, 3)) * 0.05, draw.normal(size=(n, 3)) * 0.05


def test_one_large_impulse_of_the_output_is_found_where_it_is(spark):
    gyro, source, out = motion()
    out[150, 1] += 20
    (e,) = sessions.outliers(table(spark, gyro, source, out), ["k"], "f", DT).collect()
    assert (e.kind, e.peak_frame, e.peak_axis, e.id) == ("large_impulse", 150, "Y", 1)
    assert e.start_s == pytest.approx(147 * DT - DT / 2) and e.end_s == pytest.approx(153 * DT + DT / 2) and e.duration_s == pytest.approx(7 * DT)


def test_a_gyro_fault_counts_though_the_witnesses_disagree(spark):
    gyro, source, out = motion()
    gyro[100:103, 0] += 30
    out[100:103, 0] -= 25
    out[200, 2] += 20
    gyro[200, 2] += 100  # gyro and source disagree, but only one row goes against the gyro's error: no fault, and not trusted
    found = sessions.outliers(table(spark, gyro, source, out), ["k"], "f", DT).collect()
    assert [(e.kind, e.peak_axis) for e in found] == [("gyro_fault", "X")] and 100 <= found[0].peak_frame <= 102 and found[0].against > 0.9


def test_jitter_needs_neighbours_and_missing_rows_are_left_out(spark):
    gyro, source, out = motion()
    out[120:124, 1] += [3, -3, 3, -3]
    out[220, 1] += 3  # alone
    source[50] = np.nan
    out[50] += 50
    found = sessions.outliers(table(spark, gyro, source, out), ["k"], "f", DT).collect()
    assert [e.kind for e in found] == ["micro_jitter"] and 120 <= found[0].peak_frame <= 123


def test_without_agreement_there_is_an_error(spark):
    gyro, source, out = motion()
    with pytest.raises(Exception, match="too few rows where gyro and source agree"):
        sessions.outliers(table(spark, gyro, source + 500, out), ["k"], "f", DT).collect()
    assert sessions.outliers(table(spark, gyro, source, out).where("false"), ["k"], "f", DT).count() == 0


def test_measures_of_intervals(spark):
    _, _, out = motion()
    high = filters.butterworth("high", 5.0, 1 / DT)
    fast = np.column_stack([filters.zero_phase(c, high) for c in out.T])
    df = spark.createDataFrame([("a", i, *map(float, (*v, *v, *h))) for i, (v, h) in enumerate(zip(out, fast))], "k string, f int, " + ", ".join(f"{n} double" for n in ("x", "y", "z", "dx", "dy", "dz", "hx", "hy", "hz")))
    spans = spark.createDataFrame([("a", 1, 40, 120), ("a", 2, 100, 101), ("b", 3, 0, 9)], "k string, case int, first int, last int")
    args = (["k"], "f", "case", ["x", "y", "z"], ["dx", "dy", "dz"], ["hx", "hy", "hz"], DT)
    found = {r.case: r for r in sessions.interval_measures(df, spans, *args).collect()}
    norm = lambda v: np.linalg.norm(v, axis=1)
    assert set(found) == {1, 2}
    for case, v, h in ((1, out[40:121], fast[40:121]), (2, out[100:102], fast[100:102])):
        jerk, stray = norm(np.diff(v, axis=0) / DT), norm(np.cumsum(v - v.mean(0), 0) * DT)
        want = (stray.max(), norm(v).max(), np.sqrt(np.mean(norm(v) ** 2)), jerk.max(), np.sqrt(np.mean(jerk**2)), np.sqrt(np.mean(norm(h) ** 2)))
        r = found[case]
        assert (r.excursion_peak, r.speed_peak, r.speed_rms, r.jerk_peak, r.jerk_rms, r.high_rms) == pytest.approx(want)
    one = spark.createDataFrame([("a", 1, 40, 40)], spans.schema)
    with pytest.raises(Exception, match="fewer than two rows"):
        sessions.interval_measures(df, one, *args).collect()
