"""Queries on tables that are larger or odder than the driver's: what they send, and what equal instants give."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, builds, filters
from tidemark.operators import windows as W
from tidemark.plans import catalog
from tidemark.shared import stored

TYPES = ["click", "view"]


def table(spark, folder, rows):
    """An events table of two types with rows of (seconds, value)."""
    lines = [(i, float(at), TYPES[i % 2], float(v)) for i, (at, v) in enumerate(rows)]
    df = spark.createDataFrame(lines, "event_id long, at double, event_type string, value double")
    df.select("event_id", F.timestamp_seconds(F.col("at") + 1.7e9).cast("timestamp_ntz").alias("ts"), "event_type", "value").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def by_sql(name, folder):
    with duckdb.connect() as c:
        c.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
        return c.execute(catalog.oracle_sql()[name]).fetchall()


def same(found, wanted, places=6):
    key = lambda row: tuple(map(str, row[:2]))
    found, wanted = sorted(map(tuple, found), key=key), sorted(wanted, key=key)
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted):
        for x, y in zip(a, b):
            if isinstance(y, float):
                assert x == y or (np.isnan(x) and np.isnan(y)) or abs(x - y) < 10.0**-places, (a, b)
            else:
                assert x == y, (a, b)


def broadcast_rows(plan):
    """The rows of each table that a plan, having run, sent to all."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        yield from broadcast_rows(plan.executedPlan())
    elif name.endswith("QueryStage"):
        yield from broadcast_rows(plan.plan())
    else:
        if name == "BroadcastExchange":
            yield plan.metrics().apply("numOutputRows").value()
        for i in range(plan.children().size()):
            yield from broadcast_rows(plan.children().apply(i))


def test_gradient_of_equal_instants(spark, tmp_path):
    # pairs of events of a type at one instant, with equal, rising and falling values; the ends too
    rows = [(i // 4, v) for i, v in enumerate([1, 1, 1, 2, 5, 3, 3, 9, 4, 4, 4, 4, 8, 2, 8, 1])]
    folder = table(spark, tmp_path, rows)
    found = catalog.queries()["w10_gradient"](spark, folder).collect()
    assert any(np.isinf(r.slope) for r in found) and any(np.isnan(r.slope) for r in found)
    same(found, by_sql("w10_gradient", folder))


@pytest.mark.parametrize("name", ["a03_timing_scan", "a20_bootstrap"])
def test_shifts_and_draws_are_not_broadcast(spark, tmp_path, name):
    rng = np.random.default_rng(1)
    folder = table(spark, tmp_path, [(i * 3, v) for i, v in enumerate(rng.normal(100, 40, 1300).round(2))])
    df = catalog.queries()[name](spark, folder)
    found = df.collect()
    # a row for each frame or block at most, never one for each of its shifts or draws
    assert all(n <= 1300 for n in broadcast_rows(df._jdf.queryExecution().executedPlan()))
    same(found, by_sql(name, folder))


@pytest.mark.parametrize("n", [1, 4, 15, 17, 30])
def test_timing_scan_of_short_series(spark, tmp_path, n):
    rng = np.random.default_rng(n)
    folder = table(spark, tmp_path, [(i * 3, v) for i, v in enumerate(rng.normal(100, 40, n).round(2))])
    same(catalog.queries()["a03_timing_scan"](spark, folder).collect(), by_sql("a03_timing_scan", folder))


@pytest.mark.parametrize("strict", [True, False])
def test_asof_by_stretches_is_asof(spark, strict):
    rng = np.random.default_rng(4)
    # stretches with many samples, one and none; a series of one sample, one without samples; instants on samples, between, far before and far after
    ts = {"a": np.unique(rng.integers(0, 400, 60)).astype(float), "b": np.array([5.0, 1000.0, 1001.0, 5000.0]), "c": np.array([3.0])}
    samples = spark.createDataFrame([(k, float(t), (float(t), -float(t))) for k, v in ts.items() for t in v], "k string, t double, v struct<x:double,y:double>")
    at = {"a": np.concatenate([ts["a"], rng.uniform(-300, 700, 200)]), "b": np.concatenate([ts["b"], rng.uniform(-3000, 9000, 200)]), "c": np.array([-50.0, 3.0, 90.0]), "d": np.array([1.0])}
    asked = spark.createDataFrame([(k, i, float(t)) for k, v in at.items() for i, t in enumerate(v)], "k string, i int, t double")
    wanted = []
    for k, v in at.items():
        own = ts.get(k, np.array([]))
        for i, t in enumerate(v):
            j = int(np.clip(np.searchsorted(own, t, "left" if strict else "right") - 1, 0, max(len(own) - 2, 0)))
            wanted.append((k, i, own[j], own[j + 1]) if len(own) > 1 else (k, i, None, None))
    for width in (None, 7.0, 50.0, 1e6):
        met = asof.segments(samples, asked, ["k"], "t", "v", strict, width)
        found = met.select("k", "i", "_t0", "_t1", "_v0", "_v1").collect()
        assert sorted((r.k, r.i, r._t0, r._t1) for r in found) == sorted(wanted)
        assert all(r._v0 is None if r._t0 is None else (r._v0.x, r._v0.y, r._v1.x) == (r._t0, -r._t0, r._t1) for r in found)


def test_rotations_by_stretches_are_those_of_whole_series(spark):
    rng = np.random.default_rng(5)
    ts = {"a": np.unique(rng.integers(0, 400, 60)).astype(float), "b": np.array([5.0, 1000.0, 1001.0, 5000.0]), "c": np.array([3.0])}
    unit = lambda: tuple(map(float, (lambda q: q / np.linalg.norm(q))(rng.normal(size=4))))
    samples = spark.createDataFrame([(k, float(t), unit()) for k, v in ts.items() for t in v], "k string, t double, q struct<w:double,x:double,y:double,z:double>")
    at = {"a": np.concatenate([ts["a"], rng.uniform(-300, 700, 200)]), "b": np.concatenate([ts["b"], rng.uniform(-3000, 9000, 200)]), "c": np.array([-50.0, 90.0]), "d": np.array([1.0])}
    asked = spark.createDataFrame([(k, i, float(t)) for k, v in at.items() for i, t in enumerate(v)], "k string, i int, t double")
    rows = lambda df: {(r.k, r.i): r for r in df.select("k", "i", "t", *(F.col("q")[p].alias(p) for p in "wxyz")).collect()}
    wanted = rows(asof.slerped(samples, asked, ["k"], "t", "q"))
    for width in (7.0, 50.0):
        df = asof.slerped(samples, asked, ["k"], "t", "q", width)
        found = rows(df)
        assert found.keys() == wanted.keys()
        for key, r in found.items():
            assert (r.w is None) == (wanted[key].w is None) and (r.w is None or np.allclose(r[2:], wanted[key][2:], atol=1e-12))
        # no window sorts the rows of a series, but that over one row a stretch
        assert df._jdf.queryExecution().executedPlan().toString().count("Window") <= 4


@pytest.mark.parametrize("size, chunk", [(1, 8), (3, 8), (7, 8), (7, 64)])
def test_gaps_filled_by_chunks(spark, size, chunk):
    rng = np.random.default_rng(size)
    values = {"a": rng.normal(size=90), "b": rng.normal(size=50), "c": np.full(20, np.nan), "d": np.full(40, np.nan)}
    values["a"][rng.random(90) < 0.5], values["a"][30:62], values["b"][:23], values["d"][17] = np.nan, np.nan, np.nan, 2.5
    rows = [(k, i, None if np.isnan(x) else float(x), float(i)) for k, v in values.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "k string, f int, v double, u double")
    whole = df.withColumn("v", W.filled("v", ["k"], "f"))
    wanted = {(r.k, r.f): r.m for r in W.medians(whole, ["k"], "f", size, {"m": "v"}).collect()}
    found = W.medians(df, ["k"], "f", size, {"m": "v", "n": "u"}, chunk, fill=True)
    assert found.columns == [*df.columns, "m", "n"]
    assert {(r.k, r.f): r.m for r in found.collect()} == wanted


def test_whole_series_are_rewritten_value_by_value(spark):
    rng = np.random.default_rng(8)
    rows = [(k, f, float(rng.normal()), None if f % 7 == 0 else float(rng.normal()), f * 0.5) for k, n in (("a", 45), ("b", 16), ("c", 1)) for f in range(n)]
    df = spark.createDataFrame(rows, "k string, f int, x double, y double, r double").repartition(5)
    each = spark.createDataFrame([("a", [2.0, 3.0], None), ("c", [5.0, 1.0], [4.0, 0.0])], "k string, x array<double>, y array<double>")
    seen = lambda x, more: np.cumsum(x[::-1])[::-1] * (more or [1.0, 0.0])[0] + (more or [1.0, 0.0])[1]
    found = filters.rewritten(df, ["k"], "f", {"x": seen, "y": seen}, ["r"], each, chunk=8)
    assert found.columns == ["k", "f", "r", "x", "y"]
    told = {(r.k, r.f): r for r in found.collect()}
    assert len(told) == len(rows)
    shares = {(r.k, v): r[v] for r in each.collect() for v in "xy"}
    for k in "abc":
        own = [r for r in rows if r[0] == k]
        for i, v in ((2, "x"), (3, "y")):
            wanted = seen(np.array([r[i] or 0.0 for r in own]), shares.get((k, v)))
            assert [told[k, r[1]][v] for r in own] == wanted.tolist()
        assert all(told[k, r[1]].r == r[4] for r in own)


def test_a_build_reads_its_inputs_once(spark):
    counts = {n: spark.sparkContext.accumulator(0) for n in ("samples", "frames")}

    def counted(df, name):
        def run(batches):
            for b in batches:
                counts[name].add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema)

    at = [(i, i * 5000.0, i // 4, i % 4) for i in range(1200)]
    turn = lambda t: (float(np.cos(t / 9e6)), 0.0, 0.0, float(np.sin(t / 9e6)))
    samples = spark.createDataFrame([("a", t, f, k, turn(t), False) for _, t, f, k in at], "clip string, t double, frame int, index int, q struct<w:double,x:double,y:double,z:double>, inverted boolean")
    frames = spark.createDataFrame([("a", f, 8.0 + f % 3) for f in range(300)], "clip string, frame int, exposure double")
    found, _ = builds.noise_build(counted(samples, "samples"), counted(frames, "frames"), ["clip"])
    assert found.count() == 1200
    assert (counts["samples"].value, counts["frames"].value) == (1200, 300)


def test_stored_tables_are_read_by_columns(spark):
    df = spark.createDataFrame([("a", 1, (0.1, None)), (None, 2, None)], "k string, i int, v struct<x:double,y:double>")
    found = stored(df, "test")
    assert found.dtypes == df.dtypes and sorted(map(str, found.collect())) == sorted(map(str, df.collect()))
    assert "ReadSchema: struct<i:int>" in found.select("i")._jdf.queryExecution().executedPlan().toString()
