import numpy as np
import pytest

from tidemark.operators import sequential as S
from tidemark.plans import filtering, greedy

SF = "/root/testdata/sf0.001"


def test_segments_join_while_short(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 4, 5), ("a", 8, 9), ("a", 30, 31)], "c string, s int, e int")
    found = [(r.start, r.end, r.n) for r in S.packed_segments(df, ["c"], "s", "e", 2.0, 12.0).orderBy("start").collect()]
    assert found == [(-2.0, 7.0, 2), (6.0, 11.0, 1), (28.0, 33.0, 1)]


def test_peaks_are_apart(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([9, 8, 1, 7, 7, 0, 5])], "c string, f int, v double")
    assert [(r.f, r.v) for r in S.spaced_top(df, ["c"], "f", "v", 3, 3).orderBy("place").collect()] == [(0, 9.0), (3, 7.0), (6, 5.0)]


def test_thinning_counts_from_the_last_kept(spark):
    df = spark.createDataFrame([("a", t) for t in (0.0, 3.0, 5.0, 6.0, 10.0, 11.0)], "c string, t double")
    assert sorted(r.t for r in S.thinned(df, ["c"], "t", 5.0).collect()) == [0.0, 5.0, 10.0]


def test_a_quarter_turn_in_steps(spark):
    df = spark.createDataFrame([("a", i, 0.0, 0.0, 45.0, 0.1) for i in range(20)], "c string, f int, x double, y double, z double, dt double")
    last = S.reintegrated(df, ["c"], "f", ("x", "y", "z"), "dt").orderBy("f").collect()[-1]
    assert (last.w, last.z) == pytest.approx((np.cos(np.pi / 4), np.sin(np.pi / 4)))


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rules_carry_over_batches(spark, small_batches):
    draw = np.random.default_rng(1)
    times = {c: np.cumsum(draw.integers(1, 5, 100)).tolist() for c in "ab"}
    df = spark.createDataFrame([(c, t, t + 1) for c in times for t in times[c]], "c string, t int, e int")
    kept, segments = [], []
    for c, own in times.items():
        last, at = None, None
        for t in own:
            if last is None or t - last >= 6:
                kept.append((c, t))
                last = t
            if at and t - 1.0 <= at[2] and t + 2.0 - at[1] <= 20:
                at[2:] = [t + 2.0, at[3] + 1]
            else:
                at = [c, t - 1.0, t + 2.0, 1]
                segments.append(at)
    for found in (S.thinned(df, ["c"], "t", 6.0), S.packed_segments(df, ["c"], "t", "e", 1.0, 20.0)):
        assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()  # no frame of a whole series
    assert sorted((r.c, r.t) for r in S.thinned(df, ["c"], "t", 6.0).collect()) == kept
    assert sorted(tuple(r) for r in S.packed_segments(df, ["c"], "t", "e", 1.0, 20.0).collect()) == [tuple(x) for x in segments]


def test_peaks_come_from_a_bounded_number_of_rows(spark):
    draw = np.random.default_rng(2)
    v = (draw.integers(0, 40, 2000) + np.exp(-((np.arange(2000) - 700) / 30.0) ** 2) * 100).tolist()
    taken = []
    for i in sorted(range(2000), key=lambda i: (-v[i], i)):
        if len(taken) < 5 and all(abs(i - x) >= 4 for x in taken):
            taken.append(i)
    df = spark.createDataFrame(list(zip("a" * 2000, range(2000), v)), "c string, f int, v double")
    top = S.spaced_top(df, ["c"], "f", "v", 5, 4)
    assert [r.f for r in top.orderBy("place").collect()] == taken
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" in plan and "<= 29" in plan


def test_reintegration_does_not_depend_on_chunks(spark):
    draw = np.random.default_rng(3)
    rows = [("a", i, *map(float, draw.normal(size=3) * 200), 0.02) for i in range(300)]
    df = spark.createDataFrame(rows, "c string, f int, x double, y double, z double, dt double")
    q, expected = np.array([1.0, 0.0, 0.0, 0.0]), []
    for _, _, x, y, z, dt in rows:
        v = np.radians([x, y, z]) * dt / 2
        n = np.linalg.norm(v)
        w, (x, y, z) = np.cos(n), v * np.sin(n) / n
        q = np.array([[w, -x, -y, -z], [x, w, z, -y], [y, -z, w, x], [z, y, -x, w]]) @ q
        expected.append(q)
    found = S.reintegrated(df, ["c"], "f", ("x", "y", "z"), "dt", chunk=64).orderBy("f").select(*"wxyz").collect()
    assert np.array(found) == pytest.approx(np.array(expected), abs=1e-9)


@pytest.mark.parametrize("name", [*greedy.QUERIES, *filtering.QUERIES])
def test_queries_have_rows(spark, name):
    # the spectral keep needs 400 calm rows of a series, more than the smallest tables hold
    assert {**greedy.QUERIES, **filtering.QUERIES}[name](spark, SF if name != "a09_spectral_keep" else SF.replace("sf0.001", "sf0.01")).count() > 0
