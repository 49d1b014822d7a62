"""Filters that follow a whole series: zero-phase Butterworth, spectral gain, and power by frequency.

Recursive filters run in grouped maps, one group for each chunk of a series with a halo of HALO frames on both
sides, beyond which what they remember is negligible; so long series are spread over tasks. Mean power is summed
over chunks too. A spectral gain joins a series' two ends and remembers for ever, so there a group is a whole
series, in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import quaternion as Q
from .islands import numbered
from .windows import with_halo

CHUNK, HALO = 1 << 14, 1 << 11

# Frequencies (Hz) and the share of the roll, and of the two other axes, that is kept there.
GAIN_HZ = (0, 1, 2, 3.5, 5, 6.5, 8, 10, 12, 14, 16, 18, 20, 25)
GAIN_ROLL = (1.0, 0.90, 0.77, 0.68, 0.58, 0.40, 0.29, 0.22, 0.17, 0.13, 0.10, 0.086, 0.075, 0.049)
GAIN_OTHER = (1.0, 0.93, 0.87, 0.82, 0.77, 0.72, 0.67, 0.64, 0.61, 0.48, 0.35, 0.25, 0.19, 0.19)


def butterworth(kind: str, hz: float | tuple[float, float], fps: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order Butterworth as sections (b, a): 'low', 'high', or 'band' between two frequencies."""
    warp = lambda f: 2 * fps * np.tan(np.pi * f / fps)
    poles = np.exp(1j * np.pi * np.array([3, 5]) / 4)  # of the analog low-pass at 1 rad/s
    if kind == "low":
        w = warp(hz)
        zeros, poles, gain = [], poles * w, w * w
    elif kind == "high":
        zeros, poles, gain = [0, 0], warp(hz) / poles, 1.0
    else:
        lo, hi = map(warp, hz)
        p, centre = poles * (hi - lo) / 2, lo * hi
        root = np.sqrt(p * p - centre)
        zeros, poles, gain = [0, 0], np.concatenate([p + root, p - root]), (hi - lo) ** 2
    k = 2 * fps
    zeros = np.array(zeros, complex)
    gain = gain * np.real(np.prod(k - zeros) / np.prod(k - poles))
    zeros = np.concatenate([(k + zeros) / (k - zeros), -np.ones(len(poles) - len(zeros))])
    poles = (k + poles) / (k - poles)
    upper = sorted((x for x in poles if x.imag > 0), key=lambda x: abs(x))
    pairs = np.sort_complex(zeros).real if len(upper) == 1 else np.array([-1.0, 1.0, -1.0, 1.0])
    out = []
    for i, pole in enumerate(upper):
        b = np.poly(pairs[2 * i : 2 * i + 2])
        out.append((b * (gain if i == 0 else 1.0), np.array([1.0, -2 * pole.real, abs(pole) ** 2])))
    return out


#: Rows that a section goes through in one step.
BLOCK = 64


@lru_cache(maxsize=64)
def _blocks(b: tuple, a: tuple) -> tuple[np.ndarray, ...]:
    """What a section's output (of the input and of the state before) and its state after a block are, as matrices."""
    step, enters = np.array([[-a[1], 1.0], [-a[2], 0.0]]), np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    powers = [np.eye(2)]
    for _ in range(BLOCK):
        powers.append(step @ powers[-1])
    pulse = np.array([b[0], *(float((m @ enters)[0]) for m in powers[: BLOCK - 1])])
    lag = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
    of_input = np.where(lag >= 0, pulse[np.maximum(lag, 0)], 0.0)
    return of_input, np.array([m[0] for m in powers[:BLOCK]]), np.array([m @ enters for m in powers[BLOCK - 1 :: -1]]), powers[BLOCK]


def _section(x: np.ndarray, b: np.ndarray, a: np.ndarray, level: np.ndarray) -> np.ndarray:
    """One section over the last axis of x, started as if it had always been at `level`."""
    of_input, of_state, into, across = _blocks(tuple(map(float, b)), tuple(map(float, a)))
    n, rest = x.shape[-1], x.shape[:-1]
    blocks = -(-n // BLOCK)
    whole = np.zeros((*rest, blocks * BLOCK))
    whole[..., :n] = x
    whole = whole.reshape(*rest, blocks, BLOCK)
    steady = b.sum() / a.sum() * level
    state = np.stack([steady - b[0] * level, b[2] * level - a[2] * steady], -1)
    entered, states = whole @ into, np.empty((*rest, blocks, 2))
    for k in range(blocks):
        states[..., k, :] = state
        state = state @ across.T + entered[..., k, :]
    return (whole @ of_input.T + states @ of_state.T).reshape(*rest, -1)[..., :n]


def zero_phase(x: np.ndarray, sections: list, pad: int = 15) -> np.ndarray:
    """Forward and backward over the last axis through the sections, with the ends extended by their point reflection."""
    size = x.shape[-1]
    n = min(pad, size - 1)
    if n < 1:
        return np.zeros_like(x)
    y = np.concatenate([2 * x[..., :1] - x[..., n:0:-1], x, 2 * x[..., -1:] - x[..., -2 : -n - 2 : -1]], -1)
    for _ in range(2):
        level = y[..., 0]
        for b, a in sections:
            y = _section(y, b, a, level)
            level = b.sum() / a.sum() * level
        y = y[..., ::-1]
    return y[..., n : n + size]


def spectral_gain(x: np.ndarray, fps: float, hz: tuple, gain: tuple, reflect: int = 0) -> np.ndarray:
    """x with each frequency scaled by the gain table; reflect: rows mirrored beyond both ends first."""
    n = min(reflect, len(x) - 1)
    y = np.pad(x, n, mode="reflect") if n > 0 else x
    spectrum = np.fft.rfft(y) * np.interp(np.fft.rfftfreq(len(y), 1 / fps), hz, gain)
    return np.fft.irfft(spectrum, len(y))[n : n + len(x)]


#: Rows of a window of power().
WINDOW = 128


def power(x: np.ndarray, fps: float, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and mean power of half-overlapping Hann windows of `size` rows, each less its mean."""
    size = min(size, len(x))
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    parts = [x[i : i + size] for i in range(0, len(x) - size + 1, max(1, size // 2))]
    found = [np.abs(np.fft.rfft((p - p.mean()) * hann)) ** 2 for p in parts]
    return np.fft.rfftfreq(size, 1 / fps), np.mean(found, 0) / (fps * (hann**2).sum())


def mapped(df: DataFrame, keys: list[str], order: str, value: str, name: str, f: Callable[[np.ndarray], np.ndarray], chunk: int = CHUNK, halo: int = HALO) -> DataFrame:
    """keys, order and name = f(value) of each series, with nulls as zero; f sees a chunk and its halo."""
    slim = with_halo(df.select(*keys, order, value), order, halo, halo, chunk)
    schema = T.StructType([*(slim.schema[k] for k in keys), slim.schema[order], T.StructField(name, T.DoubleType())])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        group[name] = f(np.nan_to_num(group[value].to_numpy(float)))
        return group.loc[group["_own"], [*keys, order, name]]

    return slim.groupBy(*keys, "_chunk").applyInPandas(run, schema)


#: numpy's name of what a series may be ordered by, or carry along.
_KINDS = {"smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64"}


def rewritten(df: DataFrame, keys: list[str], order: str, values: dict[str, Callable], carried: list[str] = [], each: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:  # noqa: B006
    """keys, order, carried (numbers without gaps) and values, each of which is f(value) of its whole series, with nulls as zero.

    A task holds one value of a series, and nothing else of it: 8 bytes a row, in lists of a chunk that are packed before and opened after,
    chunk by chunk. each: a row of keys and one more column of that name for each value and series that has one, which its f gets too (or null).
    """
    slim = df.select(*keys, order, *carried, *(F.col(v).cast("double").alias(v) for v in values), F.floor(F.col(order) / chunk).cast("long").alias("_chunk"))
    kinds = {c: np.dtype(_KINDS[k]) for c, k in slim.dtypes if c in (order, *carried)}
    own, binary, given = [slim.schema[k] for k in keys], T.BinaryType(), each is not None
    schema = T.StructType([*own, slim.schema["_chunk"], T.StructField("_of", T.StringType()), T.StructField("_x", binary)])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        lists = [(c, table[c].to_numpy().astype(k)) for c, k in kinds.items()] + [(v, np.nan_to_num(table[v].to_numpy())) for v in values]
        out = table.select([*keys, "_chunk"]).take(pa.array([0] * len(lists), pa.int64()))
        return out.append_column("_of", pa.array([c for c, _ in lists], pa.string())).append_column("_x", pa.array([x.tobytes() for _, x in lists], pa.binary()))

    def whole(table: pa.Table) -> pa.Table:
        f = values.get(table["_of"][0].as_py())
        more = [table["_each"][0].as_py()] if given and f else []
        table = table.select(schema.names)
        if f is None:
            return table
        table = table.sort_by("_chunk")
        size = np.cumsum([len(b.as_buffer()) // 8 for b in table["_x"]])
        x = np.concatenate([np.frombuffer(b.as_buffer()) for b in table["_x"]])
        table = table.drop_columns(["_x"])
        x = f(x, *more)
        return table.append_column("_x", pa.array([part.tobytes() for part in np.split(x, size[:-1])], pa.binary()))

    def opened(table: pa.Table) -> pa.Table:
        lists = {c: np.frombuffer(x.as_buffer(), kinds.get(c, float)) for c, x in zip(table["_of"].to_pylist(), table["_x"])}
        out = table.select(keys).take(pa.array(np.zeros(len(lists[order]), np.int64)))
        for c in (order, *carried, *values):
            out = out.append_column(c, pa.array(lists[c]))
        return out

    packed = slim.groupBy(*keys, "_chunk").applyInArrow(pack, schema)
    if given:
        told = F.coalesce(*(F.when(F.col("_of") == v, F.col(f"_e.{v}")) for v in values))
        rows = each.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.struct(*values).alias("_e"))
        packed = packed.join(F.broadcast(rows), [F.equal_null(packed[k], F.col(f"_k_{k}")) for k in keys], "left").select(*schema.names, told.alias("_each"))
    done = packed.groupBy(*keys, "_of").applyInArrow(whole, schema)
    return done.groupBy(*keys, "_chunk").applyInArrow(opened, T.StructType([*own, *(slim.schema[c] for c in (order, *carried)), *(T.StructField(v, T.DoubleType()) for v in values)]))


def mapped_whole(df: DataFrame, keys: list[str], order: str, value: str, name: str, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """keys, order and name = f(value) of each series, with nulls as zero; f sees the whole series in one task."""
    return rewritten(df.select(*keys, order, F.col(value).alias(name)), keys, order, {name: f})


def band_share(df: DataFrame, keys: list[str], order: str, value: str, fps: float, high: tuple[float, float], low: tuple[float, float], chunk: int = CHUNK) -> DataFrame:
    """keys and share: power in the high band over that in the low one, over all windows of a series; order counts from 0.

    A window belongs to the chunk of its first row, and reaches up to half a window into the next one.
    """
    if chunk % (WINDOW // 2) or chunk < WINDOW:
        raise ValueError("a chunk holds whole half windows, two at least")
    slim = with_halo(df.select(*keys, order, value), order, 0, WINDOW // 2, chunk).where("_chunk >= 0")
    schema = T.StructType([*(slim.schema[k] for k in keys), *(T.StructField(x, T.DoubleType()) for x in ("_hi", "_lo"))])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = np.nan_to_num(group.sort_values(order)[value].to_numpy(float))
        n = (len(x) - WINDOW) // (WINDOW // 2) + 1
        if n < 1 and group["_chunk"].iloc[0] > 0:  # the rest of a series, less than a window
            return group.iloc[:0][keys].assign(_hi=0.0, _lo=0.0)
        hz, p = power(x, fps)
        band = lambda b: float(p[(hz >= b[0]) & (hz <= b[1])].sum() * max(n, 1))
        return group.iloc[:1][keys].assign(_hi=band(high), _lo=band(low))

    sums = slim.groupBy(*keys, "_chunk").applyInPandas(run, schema).groupBy(*keys).agg(F.sum("_hi").alias("_hi"), F.sum("_lo").alias("_lo"))
    return sums.select(*keys, F.try_divide("_hi", "_lo").alias("share"))


def filtered_all(df: DataFrame, keys: list[str], order: str, values: list[str], f: Callable[[np.ndarray], np.ndarray], chunk: int = CHUNK, halo: int = HALO) -> DataFrame:
    """keys, order and f() of each of values, with nulls as zero; f sees a chunk and its halo."""
    slim = with_halo(df.select(*keys, order, *values), order, halo, halo, chunk)
    schema = T.StructType([*(slim.schema[k] for k in keys), slim.schema[order], *(T.StructField(v, T.DoubleType()) for v in values)])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        for v in values:
            group[v] = f(np.nan_to_num(group[v].to_numpy(float)))
        return group.loc[group["_own"], [*keys, order, *values]]

    return slim.groupBy(*keys, "_chunk").applyInPandas(run, schema)


def told_of_sums(df: DataFrame, keys: list[str], order: str, values: list[str], f: Callable[[np.ndarray, np.ndarray], Iterator[tuple]], fields: dict[str, str], edge: int, chunk: int = CHUNK, halo: int = HALO) -> DataFrame:
    """keys and fields (name -> string, long or double): the rows that f(sums, inner) tells of each chunk with its halo, nulls as zero.

    sums: the running sums of values, a row for each; they begin with the halo, as filters that pass no constant don't see what was before.
    inner: the places of the chunk's own rows but for those within `edge` of the series' ends; order counts from 0.
    """
    if edge >= halo:
        raise ValueError("the ends that are left out must be shorter than the halo")
    slim = with_halo(df.select(*keys, order, *values), order, halo, halo, chunk)
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        at = table[order].to_numpy()
        # a chunk whose halo ends early has the end of its series
        inner = np.flatnonzero(table["_own"].to_numpy() & (at >= edge) & (at <= at[-1] - edge))
        x = np.stack([np.nan_to_num(table[v].cast(pa.float64()).to_numpy()) for v in values])
        rows = list(f(np.cumsum(x, 1), inner)) if len(inner) else []
        out = table.select(keys).take(pa.array([0] * len(rows), pa.int64()))
        for i, (name, kind) in enumerate(fields.items()):
            out = out.append_column(name, pa.array([r[i] for r in rows], kinds[kind]))
        return out

    types = dict(df.dtypes)
    return slim.groupBy(*keys, "_chunk").applyInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), *(f"`{n}` {k}" for n, k in fields.items())]))


def stretches(df: DataFrame, keys: list[str], order: str, ok: Column, least: int) -> DataFrame:
    """The rows of df where ok holds, in runs without a gap of at least `least` rows: run, _pos (from 0) and _n (rows)."""
    runs = numbered(df.where(ok), keys, order, 0)
    one = Window.partitionBy(*keys, "run")
    return runs.withColumn("_pos", F.row_number().over(one.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(one)).where(F.col("_n") >= least)


def band_gain(df: DataFrame, keys: list[str], order: str, told: str, seen: str, ok: Column, fps: float, band: tuple[float, float] = (2.0, 4.0), least: int = 64, trim: int = 15, rows: int = 300) -> DataFrame:
    """keys and gain: how much of a motion is seen in a band, over runs of usable rows without their ends.

    1 where fewer than `rows` rows count or the gain is not between a half and two.
    """
    sections = butterworth("band", band, fps)
    runs = stretches(df, keys, order, ok & F.col(told).isNotNull() & F.col(seen).isNotNull(), least)
    found = filtered_all(runs, [*keys, "run", "_n"], "_pos", [told, seen], lambda x: zero_phase(x, sections))
    inner = found.where((F.col("_pos") >= trim) & (F.col("_pos") < F.col("_n") - trim))
    sums = inner.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(told) * F.col(seen)).alias("_xy"), F.sum(F.col(told) * F.col(told)).alias("_xx"))
    g = F.try_divide("_xy", "_xx")
    every = df.select(*keys).distinct().join(sums, keys, "left")
    return every.select(*keys, F.when((F.col("_n") >= rows) & (g > 0.5) & (g < 2.0), g).otherwise(1.0).alias("gain"))


def _welch(x: np.ndarray, fps: float, size: int) -> tuple[np.ndarray, int]:
    """The sum of the power of half-overlapping Hann windows, each less its straight line, and how many there are."""
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    line = np.vstack([np.arange(size), np.ones(size)]).T
    parts = [x[i : i + size] for i in range(0, len(x) - size + 1, size // 2)]
    power_ = [np.abs(np.fft.rfft((p - line @ np.linalg.lstsq(line, p, rcond=None)[0]) * hann)) ** 2 for p in parts]
    return np.sum(power_, 0) if parts else np.zeros(size // 2 + 1), len(parts)


def spectral_keep(df: DataFrame, keys: list[str], order: str, told: str, seen: str, calm: Column, fps: float, floor: float = 4.0, rows: int = 400, size: int = WINDOW, chunk: int = CHUNK) -> DataFrame:
    """keys, hz and keep: the share of each frequency of GAIN_HZ that is motion, by what is seen over what is told of it in
    calm runs, the longer the weightier. 1 below `floor`; no rows for a series with fewer than `rows` calm rows."""
    runs = stretches(df, keys, order, calm & F.col(told).isNotNull() & F.col(seen).isNotNull(), size)
    own = [*keys, "run", "_n"]
    slim = with_halo(runs.select(*own, "_pos", told, seen), "_pos", 0, size // 2, chunk).where("_chunk >= 0")
    double = T.DoubleType()
    schema = T.StructType([*(slim.schema[k] for k in own), T.StructField("_m", T.LongType()), *(T.StructField(x, T.ArrayType(double)) for x in ("_a", "_b"))])

    def part(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_pos")
        (a, m), (b, _) = (_welch(group[c].to_numpy(float), fps, size) for c in (told, seen))
        return group.iloc[:1][own].assign(_m=m, _a=[a.tolist()], _b=[b.tolist()])

    each = slim.groupBy(*own, "_chunk").applyInPandas(part, schema).where("_m > 0")
    spread = each.select(*own, "_m", F.posexplode(F.arrays_zip("_a", "_b")).alias("_k", "_p"))
    mean = spread.groupBy(*own, "_k").agg(*((F.sum(f"_p.{x}") / F.sum("_m") * F.col("_n")).alias(x) for x in ("_a", "_b")))
    power_ = mean.groupBy(*keys, "_k").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"), F.sum("_n").alias("_rows")).where(F.col("_rows") >= rows)
    result = T.StructType([*(df.schema[k] for k in keys), T.StructField("hz", double), T.StructField("keep", double)])

    def bands(group: pd.DataFrame) -> pd.DataFrame:  # size / 2 + 1 rows
        group = group.sort_values("_k")
        share = np.clip(group["_b"].to_numpy() / np.maximum(group["_a"].to_numpy(), 1e-18), 0.03, 1.0)
        hz = np.array(GAIN_HZ, float)
        keep = np.where(hz < floor, 1.0, np.interp(hz, np.fft.rfftfreq(size, 1 / fps), share))
        return pd.DataFrame({**{k: [group[k].iloc[0]] * len(hz) for k in keys}, "hz": hz, "keep": keep})

    return power_.groupBy(*keys).applyInPandas(bands, result)


def smoothed_rotations(df: DataFrame, keys: list[str], order: str, value: str, fps: float, hz: float) -> DataFrame:
    """keys, order and value: rotations (w, x, y, z) filtered part by part on one side of the sphere, of length one; an error
    where they cancel each other."""
    by = Window.partitionBy(*keys).orderBy(order)
    q = df.select(*keys, order, Q.normalized(F.col(value)).alias("_q"))
    turned = q.withColumn("_f", F.when(Q.dot(F.col("_q"), F.lag("_q").over(by)) < 0, 1).otherwise(0))
    side = F.when(F.sum("_f").over(by.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1, -1.0).otherwise(1.0)
    flat = turned.withColumn("_side", side).select(*keys, order, *((F.col("_q")[k] * F.col("_side")).alias(f"_{k}") for k in "wxyz"))
    low = butterworth("low", hz, fps)
    found = filtered_all(flat, keys, order, [f"_{k}" for k in "wxyz"], lambda x: zero_phase(x, low))
    length = F.sqrt(sum((F.col(f"_{k}") * F.col(f"_{k}") for k in "wxyz"), F.lit(0.0)))
    checked = F.when(length < 0.5, F.raise_error(F.lit("rotations cancel each other")).cast("double")).otherwise(length)
    found = found.withColumn("_l", checked)
    return found.select(*keys, order, Q.quat(*(F.col(f"_{k}") / F.col("_l") for k in "wxyz")).alias(value))
