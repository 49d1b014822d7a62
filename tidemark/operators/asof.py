"""Joins of a series with instants: the segment of samples around each instant, and values between."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import quaternion as Q


#: Seconds of a series that are joined in one task, for callers whose instants are in seconds.
STRETCH_S = 80.0


def _by_stretches(lines: DataFrame, asked: DataFrame, keys: list[str], width: float) -> tuple[DataFrame, DataFrame]:
    """lines (keys, _t, _p: a sample) and asked (keys, _t) with _b, the stretch of time of each; lines also has, for each stretch, the last sample
    before it and the first one after it, however far off these are. Instants beyond the samples are in the first or last stretch that has one."""
    b = F.floor(F.col("_t") / width)
    lines, asked = lines.withColumn("_b", b), asked.withColumn("_b", b)
    v = lines.schema["_p"].dataType["v"].dataType
    parts = [f"_p.v.{n}" for n in v.names] if isinstance(v, T.StructType) else ["_p.v"]
    whole = lambda at: F.struct(*(at(c).alias(n) for c, n in zip(parts, v.names))) if isinstance(v, T.StructType) else at(parts[0])
    # numbers one by one, so that they are aggregated by hash
    end = {n: F.struct(f("_t").alias("t"), whole(lambda c, g=g: g(c, "_t")).alias("v")).cast(lines.schema["_p"].dataType).alias(n) for n, f, g in (("_f", F.min, F.min_by), ("_l", F.max, F.max_by))}
    have = lines.groupBy(*keys, "_b").agg(*end.values())
    reach = F.broadcast(have.groupBy(*keys).agg(F.min("_b").alias("_lo"), F.max("_b").alias("_hi")))  # a row for each series
    asked = asked.join(reach, keys, "left").withColumn("_b", F.least(F.greatest("_b", "_lo"), "_hi")).drop("_lo", "_hi")
    both = have.select(*keys, "_b", "_f", "_l").union(asked.select(*keys, "_b").distinct().select(*keys, "_b", *(F.lit(None).cast(have.schema[n].dataType) for n in ("_f", "_l"))))
    marks = both.groupBy(*keys, "_b").agg(F.max("_f").alias("_f"), F.max("_l").alias("_l"))
    near = [F.last(c, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)) for c, o in (("_l", F.col("_b")), ("_f", F.col("_b").desc()))]
    beside = marks.select(*keys, "_b", *(c.alias(n) for c, n in zip(near, ("_x", "_y")))).select(*keys, "_b", F.explode(F.array_compact(F.array("_x", "_y"))).alias("_p"))
    return lines.unionByName(beside.select(*keys, F.col("_p.t").alias("_t"), "_p", "_b")), asked


def segments(samples: DataFrame, instants: DataFrame, keys: list[str], t: str, value: str, strict: bool = True, width: float | None = None) -> DataFrame:
    """The rows of instants with _t0, _v0, _t1, _v1: the samples before and after each.

    Samples have keys, t and value. The first sample of the segment is the last one below the instant
    (strict) or not above it; beyond the ends the first and the last segment hold. width: the time that is joined in one
    task, for few long series (a row for each series is broadcast); none: a series is one task.
    """
    lines = samples.select(*keys, F.col(t).alias("_t"), F.struct(F.col(t).alias("t"), F.col(value).alias("v")).alias("_p"))
    asked = instants.select(*keys, F.col(t).alias("_t"), F.struct("*").alias("_q"))
    by = keys
    if width is not None:
        lines, asked = _by_stretches(lines, asked, keys, width)
        by = [*keys, "_b"]
    lines = lines.withColumn("_s", F.lit(1 if strict else 0)).withColumn("_q", F.lit(None).cast(asked.schema["_q"].dataType))
    asked = asked.withColumn("_s", F.lit(0 if strict else 1)).withColumn("_p", F.lit(None).cast(lines.schema["_p"].dataType))
    up, down = (Window.partitionBy(*by).orderBy(*o).rowsBetween(Window.unboundedPreceding, -1) for o in ((F.col("_t").desc(), F.col("_s").desc()), ("_t", "_s")))
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    pair = lambda a, b: F.when(F.col("_p").isNotNull(), F.struct(F.col(a).alias("a"), F.col(b).alias("b")))
    # all frames run: of each row the sample after it and, where that is the first one, its segment; then the same of those before
    met = lines.unionByName(asked).withColumn("_n", last("_p", up)).withColumn("_first", last(pair("_p", "_n"), up))
    met = met.withColumn("_m", last("_p", down)).withColumn("_last", last(pair("_m", "_p"), down)).where("_q is not null")
    inner = F.when(F.col("_m").isNotNull() & F.col("_n").isNotNull(), F.struct(F.col("_m").alias("a"), F.col("_n").alias("b")))
    at = F.coalesce(inner, F.when(F.col("_m").isNull() & F.col("_first.b").isNotNull(), F.col("_first")), F.when(F.col("_n").isNull() & F.col("_last.a").isNotNull(), F.col("_last")))
    met = met.withColumn("_at", at)
    return met.select("_q.*", F.col("_at.a.t").alias("_t0"), F.col("_at.a.v").alias("_v0"), F.col("_at.b.t").alias("_t1"), F.col("_at.b.v").alias("_v1"))


def weight(t: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(t) - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))))


def read_rotations(ts: np.ndarray, qs: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The rotations (rows of w, x, y, z) at t as Q.slerp() tells them, between rotations qs at rising ts."""
    i = np.clip(np.searchsorted(ts, t, "left") - 1, 0, len(ts) - 2)
    w = np.clip((t - ts[i]) / (ts[i + 1] - ts[i]), 0.0, 1.0)
    a, b = qs[i], qs[i + 1]
    d = a[:, 0] * b[:, 0] + a[:, 1] * b[:, 1] + a[:, 2] * b[:, 2] + a[:, 3] * b[:, 3]
    angle = np.arccos(np.minimum(1.0, np.abs(d)))
    near = angle < 1e-7
    sine = np.where(near, 1.0, np.sin(angle))
    ka = np.where(near, 1 - w, np.sin((1 - w) * angle) / sine)
    kb = np.where(near, w, np.sin(w * angle) / sine) * np.where(d < 0, -1.0, 1.0)
    q = a * ka[:, None] + b * kb[:, None]
    n = np.sqrt((q * q).sum(1))
    return q / np.where(n > 0, n, 1.0)[:, None]


def _slerped_by_stretches(samples: DataFrame, instants: DataFrame, keys: list[str], t: str, value: str, width: float) -> DataFrame:
    """slerped() with keys and t first, a stretch of time in a call: samples and instants of a stretch meet by its number, and are shuffled once."""
    lines = samples.select(*keys, F.col(t).alias("_t"), F.struct(F.col(t).alias("t"), F.col(value).alias("v")).alias("_p"))
    names = [c for c in instants.columns if c not in (*keys, t)]  # the instant itself goes once
    lines, asked = _by_stretches(lines, instants.select(*keys, F.col(t).alias("_t"), F.struct(F.lit(0).alias("_"), *names).alias("_q")), keys, width)
    # both may come from one table: the keys get attributes of their own
    lines = lines.select(*(F.col(k).alias(k) for k in (*keys, "_b")), F.col("_t").cast("double").alias("_t"), *(F.col(f"_p.v.{k}").alias(k) for k in Q.PARTS))
    parts = T.StructType([T.StructField(k, T.DoubleType()) for k in Q.PARTS])
    kind = pa.struct([pa.field(k, pa.float64()) for k in Q.PARTS])

    def read(asked: pa.Table, lines: pa.Table) -> pa.Table:
        ts, first = np.unique(lines["_t"].to_numpy(), return_index=True)
        if asked.num_rows and len(ts) > 1:
            qs = np.column_stack([lines[k].to_numpy()[first] for k in Q.PARTS])
            q = read_rotations(ts, qs, asked["_t"].cast(pa.float64()).to_numpy())
            found = pa.StructArray.from_arrays([pa.array(x, from_pandas=True) for x in q.T], fields=list(kind))
        else:
            found = pa.nulls(asked.num_rows, kind)
        rest = pa.Table.from_struct_array(asked["_q"].combine_chunks())
        return pa.table([*(asked[k] for k in keys), asked["_t"], *rest.columns[1:], found], [*keys, t, *names, value])

    schema = T.StructType([*(instants.schema[c] for c in (*keys, t, *names)), T.StructField(value, parts)])
    return asked.groupBy(*keys, "_b").cogroup(lines.groupBy(*keys, "_b")).applyInArrow(read, schema)


def slerped(samples: DataFrame, instants: DataFrame, keys: list[str], t: str, value: str, width: float | None = None) -> DataFrame:
    """instants with value: the rotation at each, on the shorter arc; the end samples hold beyond the ends. width: see segments()."""
    if width is not None:
        return _slerped_by_stretches(samples, instants.drop(value), keys, t, value, width)
    met = segments(samples, instants, keys, t, value, width=width)
    return met.withColumn(value, Q.slerp(F.col("_v0"), F.col("_v1"), weight(t))).drop("_t0", "_v0", "_t1", "_v1")


def interpolated(samples: DataFrame, instants: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """instants with value on straight lines between the samples; the end samples hold beyond the ends."""
    met = segments(samples, instants, keys, t, value, strict=False)
    w = weight(t)
    line = F.when(w <= 0, F.col("_v0")).when(w >= 1, F.col("_v1")).otherwise(F.col("_v0") + (F.col("_v1") - F.col("_v0")) * w)
    return met.withColumn(value, line).drop("_t0", "_v0", "_t1", "_v1")
